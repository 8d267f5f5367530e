"""The registered queries of this subpackage: opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.shared import in_subset, table


def tokenizer_path() -> str:
    """The parameter of the tokenizing queries: a byte-level BPE file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabweave.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabweave.llm.licence_scan import licence_scan

    return licence_scan(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabweave.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabweave.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabweave.llm.secrets import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabweave.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabweave.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabweave.llm import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(in_subset("doc_id", 5) != 0))
    return quality.score(docs, model).select("doc_id", (in_subset("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabweave.llm import language_id

    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(in_subset("doc_id", 3) != 1))
    return language_id.predict(docs, model).select("doc_id", (in_subset("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabweave.llm.warc import derivatives

    return derivatives(table(spark, sf_dir, "pages"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabweave.llm.fill_middle import fill_in_middle

    return fill_in_middle(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabweave.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabweave.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_licence_scan": op2_licence_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_packing": op4_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_nearest": op6_nearest,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "op11_fill_middle": op11_fill_middle,
    "op12_collocations": op12_collocations,
    "op13_substring_dedup": op13_substring_dedup,
}
#: op3's texts are grouped by their normalised form itself, op11's lines are lists, op12's phrases are counted by rows, and
#: op13's windows compared as strings.
ORACLES: dict[str, str] = {
    "op3_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
""",
    "op11_fill_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id::VARCHAR) AS h FROM documents
), k AS (
  SELECT *, len(u) AS n, [('0x' || substr(h, i, 8))::BIGINT for i in [1, 9, 17, 25]] AS g FROM d
), c AS (
  SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 100 THEN 'plain' WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), numbered AS (
  SELECT lang, row_number() OVER () AS p, [w for w in string_split_regex(piece, '[\x20\x09]+') if w <> ''] AS ws FROM pieces
), w AS (
  SELECT lang, p, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM numbered
), g AS (
  SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY p ORDER BY i)
), f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL
), f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, 2 AS words, 1 AS k, f2.f AS a, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, 3, 1, f3.f, x.f, y.f
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, 3, 2, f3.f, x.f, y.f
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3
), scored AS (
  SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), held AS (
  SELECT lang, phrase, max(f) AS longer
  FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM f3) GROUP BY ALL
), alone AS (
  SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.longer IS NULL OR 100 * h.longer < 50 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM alone
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n::BIGINT AS n, r.score::BIGINT AS score
FROM ranked r JOIN (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang) t ON t.lang = r.lang WHERE r.rank <= 2000
""",
    "op13_substring_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, [w for w in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if w <> ''] AS ws FROM documents
), w AS (
  SELECT row, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d
), x AS (
  SELECT row, doc_id, i, word, CASE WHEN count(*) OVER o = 20 THEN string_agg(word, ' ') OVER o END AS win
  FROM w WINDOW o AS (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), s AS (
  SELECT *, win IS NOT NULL AND (min(doc_id) OVER (PARTITION BY win) < doc_id OR min(i) OVER (PARTITION BY win, row) < i) AS again FROM x
), c AS (
  SELECT *, bool_or(again) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM s
), r AS (
  SELECT row, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY row
)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(r.n_removed, 0) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (row)
""",
}
