"""The training-data operators against brute force, round trips and held-out accuracy."""

import collections
import gzip
import hashlib
import json
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabweave.llm import ann, bpe, exact_dedup, language_id, licence_scan, near_dedup, packing, quality, secrets, warc
from tabweave.llm.queries import ORACLES, QUERIES, tokenizer_path

DOCS = "doc_id bigint, text string"
SPEC = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()


@pytest.fixture(scope="module")
def texts(sf):
    return [r[0] for r in duckdb.connect().execute(f"select text from '{sf}/documents.parquet' order by doc_id").fetchall()]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = [None, "", " ", "a", "don't 'S 's''re  \n\t x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "日本語 Ⅷ ² ́é 🙂　\x85\x1c", "x" * 3000, "ab " * 4000, "a'lla 've've 'd", "  \n  a"]


# op1


def test_bpe_matches_library(texts, library):
    codec = bpe.BpeCodec(SPEC)
    rnd = random.Random(3)
    parts = ["a", "'", "s", "re", " ", "  ", "\n", "1", "é", "!", "'s", "<|endoftext|>", "🙂", "the", "ing", "aaaa", "　"]
    cases = texts + [t or "" for t in ODD] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    ids, counts = codec.encode(cases)
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, e in enumerate(library.encode_batch(cases, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == e.ids, cases[k]
    assert [b.decode() for b in codec.decode(ids, counts)] == cases
    assert 0 < codec.stats["merged"] < codec.stats["new"] < codec.stats["words"]


def test_bpe_compatibility_is_exact(library):
    codec = bpe.BpeCodec(SPEC)
    rng = np.random.default_rng(1)
    own = [i for i in range(50256) if codec.encode_words([codec.token_bytes[i].decode("utf-8", "ignore")])[1].sum() and codec.token_bytes[i].isalpha() and codec.token_bytes[i].isascii()][:4000]
    a, b = rng.choice(own, 800), rng.choice(own, 800)
    ok, _ = codec.compatible(a, b)
    for x, y, good in zip(a, b, ok):
        merged, _ = codec.merge([codec.token_bytes[x] + codec.token_bytes[y]])
        assert good == (merged.tolist() == [x, y])


def test_bpe_words_of_any_length_and_pattern(library):
    codec, rnd = bpe.BpeCodec(SPEC), random.Random(9)
    sign = [0]
    while len(sign) < 2048:
        sign += [1 - x for x in sign]
    twins = ["".join("ab"[x ^ flip] for x in sign) for flip in (0, 1)]  # equal modulo powers of two under any odd base
    cases = [*twins, " ".join(twins), "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "".join(rnd.choice("aeiou") for _ in range(5_000)), "é" * 700, "ab" * 4000]
    began = time.process_time()
    ids, counts = codec.encode(cases)
    assert time.process_time() - began < 5
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, e in enumerate(library.encode_batch(cases, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == e.ids
    words = ["".join(rnd.choice("etaoin shr") for _ in range(rnd.randint(1, 60))).encode() for _ in range(300)]
    short, counts = codec.merge(words)
    assert np.concatenate([codec.merge_long(w) for w in words]).tolist() == short.tolist() and len(counts) == 300


def test_bpe_tokens_that_do_not_encode_to_themselves(library):
    """A vocabulary in which a token's text is encoded otherwise: it is never proposed."""
    letters = {c: i for i, c in enumerate(bpe.byte_alphabet())}
    merges = ["a b", "b c", "a bc", "ab c", "abc d"]  # "abc" becomes ab + c, so "a bc" never makes it
    vocab = letters | {"ab": 256, "bc": 257, "abc": 258, "abcd": 259}
    codec = bpe.BpeCodec(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
    for text in ("abc", "abcd", "abcabcd", "bcabc", "aabcbc", "xabc"):
        ids, _ = codec.encode([text])
        word = text.encode()
        assert ids.tolist() == codec.merge([word])[0].tolist() == codec.merge_long(word)


def test_word_classes_are_the_library_s(library):
    """Every code point of the planes that hold letters or numbers: does the library join it to a letter, a number, a mark?"""
    from tokenizers import pre_tokenizers

    from tabweave.llm import arrays

    split, cls = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True), arrays.classes()
    points = [c for plane in (0, 1, 2, 3, 14) for c in range(plane << 16, (plane + 1) << 16) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 20_000):
        part = points[lo : lo + 20_000]
        for before, kind in (("a", arrays.LETTER), ("1", arrays.NUMBER), ("!", arrays.OTHER)):
            starts = {o[0] for _, o in split.pre_tokenize_str("".join(f"\n\n{before}{chr(c)}" for c in part))}
            assert [c for i, c in enumerate(part) if (4 * i + 3 not in starts) != (cls[c] == kind)] == []
    assert set(cls[0x40000:0xE0000].tolist()) | set(cls[0xF0000:].tolist()) == {arrays.OTHER}


def test_bpe_letters_of_later_unicode(library):
    codec, rnd = bpe.BpeCodec(SPEC), random.Random(4)
    parts = ["\u1c89", "\ua7cb", "\U00010d4a", "\U00010d40", "'s", " ", "a", "1", "!"]
    cases = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 8))) for _ in range(2000)]
    ids, counts = codec.encode(cases)
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, e in enumerate(library.encode_batch(cases, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == e.ids, cases[k]


def test_bpe_query_and_edges(spark, library):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(3, "a")], DOCS)
    rows = bpe.encode_decode(df, tokenizer_path(), tokens=True).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        text = ODD[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0


# op2


def brute_dice(text, template):
    words = re.findall(r"[^\W_]+", text.lower())
    want = re.findall(r"[^\W_]+", template.lower())
    t = collections.Counter(zip(want, want[1:]))
    best = 0.0
    for i in range(len(words)):
        for j in range(i + 2, min(len(words), i + 2 * len(want)) + 1):
            w = collections.Counter(zip(words[i:j], words[i + 1 : j]))
            best = max(best, 2 * sum((w & t).values()) / (sum(w.values()) + sum(t.values())))
    return best


def test_licence_scan(spark):
    mit = licence_scan.TEMPLATES["MIT"][2]
    noisy = mit.replace("merge, ", "").replace("sublicense", "relicense")
    rows = [(0, "Intro words here. Released under the MIT License. More."), (1, mit), (2, "prefix text " + noisy + " trailing words"), (3, "nothing to see"), (4, None), (5, ""), (6, "the License is the License under the"), (7, "Licensed under the Apache License, Version 2.0")]
    out = {r.doc_id: r for r in licence_scan.licence_scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert [out[k].licence for k in range(8)] == ["MIT", "MIT", "MIT", None, None, None, None, "Apache-2.0"]
    assert out[1].dice == 1.0 and 0.8 <= out[2].dice < 1.0
    name, s, e = out[0].matches.split(":")
    assert rows[0][1][int(s) : int(e)] == "Released under the MIT License"
    scanner = licence_scan.LicenceScanner({"T": ["alpha beta gamma delta epsilon zeta"]})
    rnd = random.Random(2)
    for _ in range(300):
        text = " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta".split()) for _ in range(rnd.randint(1, 14)))
        found = scanner.scan([text])[0]
        want = brute_dice(text, "alpha beta gamma delta epsilon zeta")
        assert (max((f[1] for f in found), default=0) == pytest.approx(want)) if want >= 0.8 else not found


# op3


def test_quotient_filter_merges_losslessly():
    rng = np.random.default_rng(0)
    total, filters = collections.Counter(), []
    for q in (4, 6, 9):
        keys, counts = np.unique(rng.integers(0, 1 << 16, 900).astype(np.uint64), return_counts=True)
        total.update(dict(zip(keys.tolist(), counts.tolist())))
        f = exact_dedup.CountingQuotientFilter.build(keys, counts, q, 16 - q)
        row = f.row(0)
        filters.append(exact_dedup.CountingQuotientFilter.of_row(row, 16).requotiented(9))
    merged = exact_dedup.CountingQuotientFilter.merge(filters)
    assert dict(zip(*(x.tolist() for x in merged.items()))) == dict(total)
    k = next(iter(total))
    assert merged.count(k) == total[k]


def test_exact_dedup(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (7, "x"), (7, "x"), (8, "a b "), (4, "é b")] + [(100 + i, "hot\n text") for i in range(300)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    out = exact_dedup.exact_dedup(df).collect()
    assert len(out) == len(rows)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept = collections.Counter()
    for r in out:
        assert r.keep_id == min(by_sha[r.text_sha256]) and r.group_size == len(by_sha[r.text_sha256])
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    wide = df.withColumn("lang", df.doc_id).withColumn("kept", df.text)
    left = exact_dedup.drop_exact(wide).collect()
    assert sorted(norm(r.text) for r in left) == sorted(groups) and left[0].asDict().keys() == {"doc_id", "text", "lang", "kept"}
    assert exact_dedup.exact_dedup(df.filter("false")).count() == 0


def test_exact_dedup_against_sql(spark, sf):
    got = sorted(map(tuple, QUERIES["op3_exact_dedup"](spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(con.execute(ORACLES["op3_exact_dedup"]).fetchall())


# op4


def check_packing(rows, lengths):
    seqs, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.length > 0
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length))
    pad = 0
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 1024
        pad += 0 if at & (at - 1) == 0 else 1024 - at
    for d, n in lengths.items():
        at = 0
        for s, k in sorted(docs[d]):
            assert s == at
            at += k
        assert at == n
    return pad


def test_packing(spark, library):
    texts = [None, "", "a b c", "word " * 2500, "é" * 700] + ["text number %d " % i * (i % 40) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    rows = packing.pack_documents(df, tokenizer_path(), tokens=True).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert check_packing(rows, {i: len(x) for i, x in ids.items()}) == 0
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == own and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    assert packing.pack_documents(df.filter("false"), tokenizer_path()).count() == 0


def test_packing_of_rests_is_whole_and_full():
    rnd = random.Random(4)
    for capacity in (16, 128, 1024):
        for n in (0, 1, 2, 7, 60, 300):
            lengths = [rnd.choice([1, capacity - 1, capacity, rnd.randint(1, 3 * capacity)]) for _ in range(n)]
            used, seqs = collections.defaultdict(list), collections.defaultdict(list)
            for i, s, k, seq, at in packing.pack(lengths, capacity):
                used[i].append((s, k))
                seqs[seq].append((at, k))
            for held, whole in [(used[i], x) for i, x in enumerate(lengths)] + [(x, sum(k for _, k in x)) for x in seqs.values()]:
                assert [s for s, _ in sorted(held)] == [sum(k for _, k in sorted(held)[:j]) for j in range(len(held))] and sum(k for _, k in held) == whole
            sizes = [sum(k for _, k in x) for x in seqs.values()]
            assert all(x == capacity or x < capacity and x & (x - 1) == 0 for x in sizes) and sum(x < capacity for x in sizes) <= capacity.bit_length()


def test_packing_takes_ids_of_any_type(spark):
    for kind in ("smallint", "decimal(20,0)", "string", "date"):
        df = spark.createDataFrame([(1, "a b c"), (None, "d"), (1, "a b c")], "k int, text string").selectExpr("date_add(date'1970-01-01', k) as doc_id" if kind == "date" else f"cast(k as {kind}) as doc_id", "text", "k as start", "k as length")
        rows = packing.pack_documents(df, tokenizer_path()).collect()
        assert sum(r.length for r in rows) == sum(r.n_tokens + 1 for r in bpe.encode_decode(df, tokenizer_path()).collect())


def test_differencing_balances():
    rnd = random.Random(5)
    sizes = [rnd.randint(1, 100) for _ in range(400)]
    loads = np.bincount(packing.difference(sizes, 10), weights=sizes)
    assert loads.max() - loads.min() <= 3
    for _ in range(40):
        sizes = [rnd.randint(1, 100) for _ in range(rnd.randint(1, 60))]
        window, k = packing.whole_windows(sizes, 128)
        assert np.bincount(window, weights=sizes).max() <= 128 and window.max() < k


# op5


def brute_secrets(text):
    spans = []
    for m in re.finditer(r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_secret_base_spans(texts):
    scanner = secrets.Scanner()
    rnd = random.Random(8)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abcdefgh", "x1", "AKIA", "ABCDEFGHIJKL12", "0123456789abcdef", "é", "Key", "İ", "-"]
    for t in texts + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14))) for _ in range(5000)]:
        assert scanner.base(t) == brute_secrets(t), t


def test_secret_entropy():
    rules, rnd = secrets.SecretRules(), random.Random(1)
    for _ in range(200):
        s = "".join(rnd.choice("abcdefABCXYZ0123456789+/") for _ in range(rnd.randint(20, 60)))
        for cls in rules.classes:
            covered = set()
            for i in range(len(s) - rules.window + 1):
                w = s[i : i + rules.window]
                p = np.array(list(collections.Counter(w).values())) / rules.window
                if -(p * np.log2(p)).sum() >= cls.bound - 1e-9:
                    covered |= set(range(i, i + rules.window))
            got = {k for a, b in secrets.window_spans(s, rules, cls) for k in range(a, b)}
            assert got == covered
    scan = lambda t: secrets.listed(secrets.Scanner().entropy(t))
    assert scan("key wJalrXUtnFEMIK7MDENGbPxRfiCYzzzzkq9 end").startswith("entropy:4:")
    assert scan("id 123e4567-e89b-12d3-a456-426614174000 and some_long_identifier_name_here and 12345678901234567890123") == ""


def test_secret_entropy_of_named_and_two_kind_keys():
    scan = lambda t: secrets.listed(secrets.Scanner().entropy(t))
    for name in ("", "id=", "KEY=", "some/path/", "a_b-"):
        for key in ("x7k2m9q4w8z1p5t3r6v0b2n4c8", "X7K2M9Q4W8Z1P5T3R6V0B2N4C8", "9F86D081E4C7B2A3560F1D", "3fa9c1b07de2846590ab", "MFZWI3D1NZ4GCYLTNB2X63"):
            (span,) = secrets.Scanner().entropy(f"see {name}{key} end")  # the class of all characters may take the name in
            assert 4 <= span[0] <= 4 + len(name) and span[2] == 4 + len(name) + len(key), (name, key)
    assert scan("2024-01-02x7k2M9q4W8z1p5T3r6v0") != "" != scan("2024-01-02_X7k2M9q4W8z1p5T3r6v0")
    for harmless in ("2024-01-02T10-20-30Z", "2024-01-02T102030123456Z", "2024-01-02-Some-Long-Blog-Title", "path/to/some/long/file-name2024", "date20240102103040506070", "id=123e4567-e89b-12d3-a456-426614174000"):
        assert scan(f"see {harmless} end") == "", harmless


def test_secret_query_and_redaction(spark):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCY9kq9"
    rows = [(0, None), (1, ""), (2, "token = 'abcdefgh12'"), (3, f"see {key} there"), (4, "clean text"), (4, "clean text")]
    out = secrets.secret_scan(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == 6 and {(r.doc_id, r.n_assign, r.n_entropy) for r in out} == {(0, 0, 0), (1, 0, 0), (2, 1, 0), (3, 0, 1), (4, 0, 0)}
    assert [r.base_sha256 for r in out if r.doc_id == 0][0] == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, DOCS)).collect()}
    assert clean[0] is None and clean[4] == "clean text" and key not in clean[3] and "abcdefgh12" not in clean[2]


# op6


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[1000:2000] = x[7]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] + [1.0] * 23), (5003, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    from pyspark.sql import functions as F

    out = ann.nearest(df, F.col("id") % 100 == 0, ann.AnnParams(shard_rows=512)).collect()
    again = ann.nearest(df.orderBy(F.rand(3)).repartition(7), F.col("id") % 100 == 0, ann.AnnParams(shard_rows=900)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))  # neither layout nor shards change what is found
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    found = collections.defaultdict(list)
    for r in out:
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 100):
        got = sorted(found[q])
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        s = unit @ unit[q]
        assert [g[2] for g in got] == pytest.approx([s[g[1]] for g in got])
        s[q] = -9
        s = np.round(s, 12)
        hits += len({g[1] for g in got} & set(np.lexsort((np.arange(3000), -s))[:5].tolist()))
    assert hits / 150 >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few, F.col("id") == 0).collect()] == [(0, 1)]
    assert ann.nearest(few.filter("false"), F.col("id") == 0).count() == 0


def test_pigeonhole_retrieves_all_within_radius():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(2000, 32))
    hasher = ann.learn(v, ann.AnnParams())
    shard = ann.Shard(np.arange(2000), v, hasher)
    for radius in (20, 33, 41):
        hasher.radius = radius
        for i in range(0, 2000, 400):
            want = np.flatnonzero(ann.distances(shard.codes, shard.codes[i]) <= radius)
            assert shard.within(shard.codes[i]).tolist() == want.tolist()


def test_index_prunes_clustered_rows_and_reranks_few():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(400, 48))
    for spread, most in ((0.1, 0.02), (9.0, 0.1)):  # tight groups, and next to none
        v = np.repeat(centres, 20, axis=0) + spread * rng.normal(size=(8000, 48))
        hasher = ann.learn(v, ann.AnnParams())
        shard = ann.Shard(np.arange(8000), v, hasher)
        unit = v / ann.lengths_of(v)[:, None]
        hits = 0
        for i in range(0, 8000, 100):
            got = shard.search(i, v[i], 5)
            s = unit @ unit[i]
            s[i] = -9
            hits += len({g for g, _ in got} & set(np.argsort(-s)[:5].tolist()))
        share = shard.reranked / (80 * 8000)
        print(f"spread {spread}: recall {hits / 400:.3f}, share of rows reranked {share:.5f}, radius {hasher.radius}")
        assert hits / 400 >= 0.9 and share <= most


def test_nearest_with_components_beyond_squares(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1e200, 1e200]), (1, [1.0, 1.0]), (2, [1e-200, 0.0]), (3, [0.0, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id smallint, embedding array<double>").withColumn("id", F.lit(0))
    got = [(r.query_id, r.vec_id, round(r.score, 9)) for r in ann.nearest(df, F.col("id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1.0), (0, 2, round(0.5**0.5, 9)), (0, 3, round(0.5**0.5, 9))]


# op7


def edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        i = rnd.randrange(len(out)) if out else 0
        if rnd.random() < 0.4 and out:
            out[i] = f"n{rnd.randrange(10**6)}"
        elif rnd.random() < 0.5 and out:
            del out[i]
        else:
            out.insert(i, f"n{rnd.randrange(10**6)}")
    return out


def test_alignment_is_exact():
    rnd = random.Random(6)
    a = [[rnd.randrange(12) for _ in range(rnd.randint(0, 70))] for _ in range(200)]
    b = [[x if isinstance(x, int) else 99 + hash(x) % 1000 for x in edited(rnd, t, rnd.randint(0, len(t) // 3 + 1))] for t in a]
    x, y = [np.array(t, np.int64) for t in a], [np.array(t, np.int64) for t in b]
    want = [edit_distance(s, t) for s, t in zip(a, b)]
    assert near_dedup.verified(x, y, 0.8).tolist() == [d <= int(0.2 * max(len(s), len(t)) + 1e-9) for d, s, t in zip(want, a, b)]
    assert [near_dedup.wide_distance(s, t, 10**6) for s, t in zip(a, b)] == want


def test_near_dedup_finds_planted_copies(spark):
    rnd = random.Random(7)
    rows, base = [], {}
    passage = [f"p{i}" for i in range(60)]
    for d in range(150):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(80, 200))]
        rows.append((d, " ".join(words)))
        if d % 3 == 0:
            rows.append((1000 + d, " ".join(edited(rnd, words, 3)).upper()))
            base[1000 + d] = d
    for i in range(40):  # a passage that different documents share
        rows.append((2000 + i, " ".join([f"q{rnd.randrange(5000)}" for _ in range(70)] + passage + [f"q{rnd.randrange(5000)}" for _ in range(70)])))
    hot = [f"h{i}" for i in range(120)]
    rows += [(3000 + i, " ".join(edited(rnd, hot, 4))) for i in range(200)] + [(4000 + i, " ".join(hot)) for i in range(100)]
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "one  two"), (5004, "one three")]
    out = {r.doc_id: r for r in near_dedup.near_dedup(spark.createDataFrame(rows, DOCS).repartition(4), near_dedup.NearParams(block=32)).collect()}
    assert len(out) == len(rows)
    for d, b in base.items():
        assert out[d].class_id == out[b].class_id == b and not out[d].kept
    assert all(out[2000 + i].class_id == 2000 + i for i in range(40))
    assert {out[3000 + i].class_id for i in range(200)} | {out[4000 + i].class_id for i in range(100)} == {3000}
    assert out[5001].class_id == 5000 and out[5003].class_id == 5002 and out[5004].class_id == 5004
    assert all(out[d].class_id == d for d in range(150))
    df = spark.createDataFrame(rows, DOCS).withColumn("class_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("own"))
    kept = near_dedup.drop_near(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(d for d, r in out.items() if r.kept) and kept[0].class_id == "own"
    assert near_dedup.near_dedup(df.filter("false").drop("class_id")).count() == 0


def test_near_dedup_finds_links_at_the_bound(spark):
    """Scattered edits at similarity 0.80 to 0.85, and short texts, against all pairs."""
    rnd, texts = random.Random(12), []
    for n in (15, 20, 30, 60, 100):
        for share in (0.15, 0.2) * 5:
            words = [f"w{rnd.randrange(2000)}" for _ in range(n)]
            other, edits = list(words), int(share * n + 1e-9)
            for e in range(edits):  # evenly spaced, the worst case for k-mers
                other[e * n // edits] = f"n{rnd.randrange(10**6)}"
            texts += [words, other]
    for n in range(5, 15):
        for _ in range(12):
            words = [f"s{rnd.randrange(400)}" for _ in range(n)]
            texts += [words, edited(rnd, words, n // 5)]
    texts += [[f"v{rnd.randrange(3)}" for _ in range(rnd.randint(1, 7))] for _ in range(60)]
    same = [[near for near in near_dedup.verified([np.array([hash(x) for x in t], np.int64)] * len(texts), [np.array([hash(x) for x in u], np.int64) for u in texts], 0.8)] for t in texts]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        least = [min(root[j] for j, near in enumerate(row) if near) for row in same]
        if least == root:
            break
        root = least
    assert sum(a != b for a, b in enumerate(root)) > 150
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS).repartition(4)
    assert {r.doc_id: r.class_id for r in near_dedup.near_dedup(df, near_dedup.NearParams(block=32)).collect()} == dict(enumerate(root))
    # the bound of the length and word counts never turns a link away
    w = [near_dedup.word_hashes([" ".join(t)]) for t in texts]
    bins = np.concatenate([near_dedup.word_bins(*x) for x in w])
    order = np.argsort([len(t) for t in texts], kind="stable")
    some = near_dedup.may_link(np.zeros(len(texts), np.int64), np.array([len(texts[k]) for k in order]), bins[order], 0.8)
    assert all(ok or sum(same[k]) == 1 for k, ok in zip(order, some))


def test_near_dedup_settles_lengths_before_any_join(spark, monkeypatch):
    """Members carry both lengths, so pairs that they rule out meet no join: what is left is joined with bins alone, twice."""
    plans, rows, write = {}, {}, near_dedup.stored

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        rows[name] = out = write(df, name)
        if name == "near-members":
            rows[name] = out.collect()
        return out

    monkeypatch.setattr(near_dedup, "stored", seen)
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 40))) for _ in range(200)]
    df = spark.createDataFrame([*enumerate(texts), (200, texts[0] + " z")], DOCS)
    assert near_dedup.near_dedup(df).count() == 201
    n = {r.node: r.n_words for r in rows["near-members"]}
    assert len(n) > 1 and all(r.n_lead == n[r.lead] for r in rows["near-members"] if r.lead in n)
    assert plans["near-pairs"].count("Join ") == 2 and plans["near-placed"].count("Join ") == 1


def test_near_dedup_goes_by_row(spark):
    """Against all pairs on 500 texts whose ids repeat; a row goes for what it is, not for its id."""
    rnd, rows = random.Random(21), []
    for k in range(130):
        words = [f"w{rnd.randrange(900)}" for _ in range(rnd.choice([1, 4, 9, 16, 40, 120]))]
        for _ in range(rnd.randint(1, 6)):
            rows.append((rnd.randrange(200), " ".join(edited(rnd, words, rnd.randint(0, len(words) // 6)))))
    rows = rows[:490] + [(7, "same row")] * 3 + [(None, "no id here")] * 2 + [(1000, "a b c d e f g"), (1005, "a b c d e f g"), (1005, "of its own"), (None, "a b c d e f g"), (1001, None)]
    words = [(t or "").lower().split() for _, t in rows]
    arrays = [np.array([zlib.crc32(x.encode()) for x in w], np.int64) for w in words]
    root = list(range(len(rows)))
    order = {}
    for i, w in enumerate(words):
        order.setdefault(tuple(w), i)
    distinct = sorted(order.values())
    pairs = [(i, j) for a, i in enumerate(distinct) for j in distinct[a + 1 :]]
    ok = near_dedup.verified([arrays[i] for i, _ in pairs], [arrays[j] for _, j in pairs], 0.8)
    find = lambda x: x if root[x] == x else find(root[x])
    for (i, j), near in [*zip(pairs, ok), *(((order[tuple(w)], i), True) for i, w in enumerate(words))]:
        if near and find(i) != find(j):
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    want = collections.Counter()
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        want.update((rows[i][0], rows[i][1], min(ids, default=None), len(members)) for i in members)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = near_dedup._class_rows(df, near_dedup.NearParams(block=16, block_words=500), "doc_id", "text").collect()
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in got) == collections.Counter((i, c, n) for i, _, c, n in want.elements())
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.class_id for r in got if r.kept)
    left = near_dedup.drop_near(df.withColumn("mark", df.text).withColumn("lang", df.doc_id)).collect()
    assert len(left) == len(groups) and (1005, "of its own") in {(r.doc_id, r.text) for r in left} and left[0].asDict().keys() == {"doc_id", "text", "mark", "lang"}
    assert collections.Counter(r.doc_id for r in left) == collections.Counter(r.doc_id for r in got if r.kept)


# op8, op9


def held(sql, sf):
    return duckdb.connect().execute(sql.format(sf=sf)).fetchall()


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = dict(held("select doc_id, quality from '{sf}/labels.parquet'", sf))
    rows = QUERIES["op8_quality"](spark, sf).collect()
    assert len(rows) == held("select count(*) from '{sf}/documents.parquet'", sf)[0][0]
    out = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(a == b for a, b in out) / len(out) >= 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, "good words here now %d" % i) for i in range(30)] + [(100, None), (101, ""), (102, "!!! ### %%%")], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(2, None), (1, 1)], "doc_id bigint, quality int")
    assert quality.score(docs, quality.train(docs, labels)).count() == 33
    none = quality.train(docs, labels.filter("false"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = dict(held("select doc_id, lang from '{sf}/documents.parquet'", sf))
    rows = [r for r in QUERIES["op9_language_id"](spark, sf).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) / len(rows) >= 0.97


def test_language_filter_edges(spark):
    rows = [(i, f"the house and the garden {i}", "en") for i in range(20)] + [(50 + i, f"das haus und der garten {i}", "de") for i in range(20)] + [(99, "x", None)]
    model = language_id.train(spark.createDataFrame(rows, DOCS + ", lang string"))
    langs, score = model.predict(["the garden", "der garten und das", "", "123 !!", "the"])
    assert langs == ["en", "de", "und", "und", "en"] and ((score >= 0) & (score <= 1)).all()
    keys = np.unique(language_id.grams(["the house"])[0])
    assert (model.languages_of(keys)[:, 0] & np.uint64(1 << model.names.index("en"))).mean() >= 0.5
    assert language_id.train(spark.createDataFrame(rows, DOCS + ", lang string").filter("false")).predict(["a"])[0] == ["und"]


# op10


def test_warc_records(spark, tmp_path):
    page = '<html lang="de"><head><title>T &amp; x</title><style>p{}</style></head><body><!-- gone --><p>Hallo <b>Welt</b><br>zwei &lt;3</p><script>var a="</p>";</script><a href="/x?a=1&amp;b=2">Ziel</a> 1 < 2</body></html>'
    rows = [(0, "http://e.org/", page), (1, None, None), (2, "http://e.org/2", ""), (3, "u", "<p>open <!-- never closed"), (0, "http://e.org/", page)]
    out = warc.derivatives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), whole=True).collect()
    assert len(out) == 10
    by = {(r.page_id, r.record_type): r for r in out}
    conversion, metadata = by[0, "conversion"], by[0, "metadata"]
    assert conversion.block == "Hallo Welt\nzwei <3\nZiel 1 < 2"
    assert "title: T & x" in metadata.block and "language: de" in metadata.block and "outlink: /x?a=1&b=2" in metadata.block and "source-header-content-type: text/html" in metadata.block
    assert conversion.refers_to == metadata.refers_to and conversion.linked_id == metadata.record_id and metadata.linked_id == conversion.record_id
    assert by[3, "conversion"].block == "open" and by[2, "conversion"].block == "" and by[1, "conversion"].target_uri is None
    path = tmp_path / "x.warc"
    path.write_bytes(b"".join(bytes(r.record) for r in out))
    parsed = warc.read_warc(spark, str(path)).collect()
    assert sorted(p.headers["WARC-Record-ID"] for p in parsed) == sorted(r.record_id for r in out)
    assert all(p.headers["WARC-Block-Digest"] == warc.digest(bytes(p.block)) and p.headers["WARC-Refers-To"].startswith("<urn:uuid:") for p in parsed)


def test_warc_responses_keep_their_own_values(spark, tmp_path):
    body = gzip.compress("<html><title>Tür</title><p>schön".encode("latin-1"))
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in (body[:9], body[9:], b""))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\nSet-Cookie: a=1\r\nset-cookie: b=2\r\nX-Own:  kept\r\n\r\n" + chunked
    plain, image = b"HTTP/1.0 404 Not Found\r\nContent-Type: text/plain\r\n\r\n1 < 2 & <b>", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG<p>"
    head = lambda kind, k: [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{k}>"), ("WARC-Date", f"2024-05-0{k}T01:02:03Z"), ("WARC-Target-URI", f"http://e.org/{k}")]
    size = lambda block: [("Content-Length", str(len(block)))]
    records = [(head("request", 1), b"GET / HTTP/1.1\r\n\r\n"), ([*head("response", 2), ("WARC-Payload-Digest", "sha1:OWN"), ("WARC-Block-Digest", "sha1:BLOCK")], http), (head("response", 3), plain), (head("response", 4), image)]
    (tmp_path / "r.warc").write_bytes(b"".join(warc.record_bytes(h + size(b), b) for h, b in records))
    out = {(r.refers_to, r.record_type): r for r in warc.response_derivatives(warc.read_warc(spark, str(tmp_path / "r.warc")), whole=True).collect()}
    assert sorted(out) == sorted((f"<urn:uuid:{k}>", t) for k in (2, 3, 4) for t in ("metadata", "conversion"))
    metadata, conversion = out["<urn:uuid:2>", "metadata"], out["<urn:uuid:2>", "conversion"]
    assert conversion.block == "schön" and "title: Tür\r\n" in metadata.block and metadata.source_digest == "sha1:OWN" and metadata.target_uri == "http://e.org/2"
    assert [x for x in metadata.block.split("\r\n") if x.startswith("source-")] == ["source-record-id: <urn:uuid:2>", "source-payload-digest: sha1:OWN", "source-block-digest: sha1:BLOCK", "source-header-content-type: text/html; charset=iso-8859-1", "source-header-content-encoding: gzip", "source-header-transfer-encoding: chunked", "source-header-set-cookie: a=1", "source-header-set-cookie: b=2", "source-header-x-own: kept"]
    (headers, _), = warc.parse_records(bytes(conversion.record))
    assert headers["WARC-Refers-To"] == "<urn:uuid:2>" and headers["WARC-Date"] == headers["WARC-Refers-To-Date"] == "2024-05-02T01:02:03Z" and headers["WARC-Source-Payload-Digest"] == "sha1:OWN"
    assert out["<urn:uuid:3>", "conversion"].block == "1 < 2 & <b>" and out["<urn:uuid:3>", "conversion"].source_digest == warc.digest(b"1 < 2 & <b>")
    assert out["<urn:uuid:4>", "conversion"].block == ""


def test_warc_head_without_end_tag():
    start, rest = '<html><head><meta charset="utf-8"><title>x &amp; y</title><script>var a = "<p>no</p>"</script><style>p{}</style>', '<p>text</p><a href=/y>link</a>'
    for middle in ("", "</head>", "<body>", "</head><body>"):
        page = warc.read_html(start + middle + rest)
        assert (page.title, page.text, page.links) == ("x & y", "text\nlink", ["/y"]), middle


def test_warc_gz_round_trip(spark, tmp_path):
    """From gzipped response files with real headers to derivatives that name the same ids and digests."""
    pages = [f"<html><head><title>n{k}</title></head><body><p title='a>b' class=\"x>y\">text {k} é</p><a data-x='>' href='/l{k}'>l</a></body></html>" for k in range(5)]
    records = []
    for k, page in enumerate(pages):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nServer: s%d\r\n\r\n" % k + page.encode()
        head = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{k}>"), ("WARC-Date", f"2024-05-0{k + 1}T01:02:03Z"), ("WARC-Target-URI", f"http://e.org/{k}"), ("WARC-Block-Digest", warc.digest(block)), ("WARC-Payload-Digest", warc.digest(page.encode())), ("Content-Length", str(len(block)))]
        records.append(warc.record_bytes(head, block))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[:3]))
    (tmp_path / "in/b.warc.gz").write_bytes(gzip.compress(b"".join(records[3:])))
    out = warc.response_derivatives(warc.read_warc(spark, str(tmp_path / "in")), whole=True).collect()
    (tmp_path / "out.warc.gz").write_bytes(b"".join(gzip.compress(bytes(r.record)) for r in out))
    back = {(r.headers["WARC-Refers-To"], r.headers["WARC-Type"]): r for r in warc.read_warc(spark, str(tmp_path / "out.warc.gz")).collect()}
    assert len(back) == len(out) == 10
    for k, page in enumerate(pages):
        conversion, metadata = back[f"<urn:uuid:{k}>", "conversion"], back[f"<urn:uuid:{k}>", "metadata"]
        assert bytes(conversion.block).decode() == f"text {k} é\nl" and conversion.headers["WARC-Source-Payload-Digest"] == warc.digest(page.encode())
        assert conversion.headers["WARC-Block-Digest"] == warc.digest(bytes(conversion.block)) and f"source-header-server: s{k}" in bytes(metadata.block).decode() and f"outlink: /l{k}" in bytes(metadata.block).decode()


def test_warc_ids_and_edges(spark):
    rows = [(1, "u", "<p>x"), (2, "u", "<p>x"), (3, "u", "w " * 300_000), (4, "u", "<p " + 'a="' * 2000)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("cast(page_id as smallint) as page_id", "url", "html", "html as block", "url as record_id")
    out = warc.derivatives(df).collect()
    assert len({r.record_id for r in out}) == 8 and {r.page_id for r in out} == {1, 2, 3, 4}
    assert [len(r.block) for r in out if r.page_id == 3 and r.record_type == "conversion"] == [599_999]
    assert warc.derivatives(df.filter("false")).count() == 0


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "a  b"), (None, "alone"), (None, "twice"), (None, "twice")], DOCS)
    out = exact_dedup.exact_dedup(df).collect()
    assert sorted((r.group_size, r.kept) for r in out) == [(1, True), (2, False), (2, False), (2, True), (2, True)]
    assert sorted(r.text for r in exact_dedup.drop_exact(df).collect()) == ["a  b", "alone", "twice"]
