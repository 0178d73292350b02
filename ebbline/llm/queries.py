"""Registered queries of the text operators: each over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.llm import (
    block_search, decontamination, importance, jaccard_join, language, line_dedup, pii, quality, segmentation, spelling, token_counts, token_file,
    warc,
)
from ebbline.llm.common import held_out, table


def tokenizer_file(name: str) -> str:
    """The public tokenizer file; EBBLINE_TOKENIZERS names another folder."""
    folder = os.environ.get("EBBLINE_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segmentation.sample_segmentations(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    one = found.select("doc_id", F.explode_outer("samples").alias("s"))
    return one.select(
        "doc_id", "s.rank", F.size("s.ids").alias("n_ids"), F.xxhash64("s.ids").alias("ids_hash"), "s.log_prob", "s.perturbed", "s.inclusion", "s.exact",
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out())
    return quality.score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = block_search.codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return block_search.top_k(rows, is_query=F.col("id") % 20 == 0, k=20)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language.fit(docs, "text", "lang", learn=~held_out(), key="doc_id")
    return language.identify(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), with_ids=False)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_segmentation": op1_segmentation,
        "op2_decontamination": op2_decontamination,
        "op3_quality": op3_quality,
        "op4_token_counts": op4_token_counts,
        "op5_block_search": op5_block_search,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_language": op7_language,
        "op8_line_dedup": op8_line_dedup,
        "op9_warc": op9_warc,
        "op10_pii": op10_pii,
        "op11_importance": op11_importance,
        "op12_token_file": op12_token_file,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2, "op5_block_search": OP5, "op6_jaccard_join": OP6, "op9_warc": OP9, "op11_importance": OP11, "op13_spelling": OP13}


OP2 = r"""
WITH d AS (
  SELECT doc_id, text, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: w[i : i + least(len(w), 10) - 1])) AS gram
  FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT size FROM g),
p AS (
  SELECT doc_id, s.size, unnest(range(1, len(w) - s.size + 2)) AS place, unnest(list_transform(range(1, len(w) - s.size + 2), lambda i: w[i : i + s.size - 1])) AS gram
  FROM d, s WHERE len(w) >= s.size),
h AS (SELECT doc_id, place, p.size, item FROM p JOIN g ON p.gram = g.gram),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + size)) AS x FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP5 = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.c, d.c), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q, e d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP6 = r"""
WITH RECURSIVE
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id, doc_id AS reach FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""


def crc32_sql(strings: str, name: str) -> str:
    """Common table expressions that end in ``name`` (s, crc): the crc32 of each of the distinct ``strings`` (s).

    A crc is the exclusive or of what each byte adds at its distance from the end, and of a share of the length.
    """
    def step(x: str) -> str:
        return f"list_reduce([{x}, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))"

    return f"""
{name}_t AS (SELECT b, {step("b::BIGINT")} AS c FROM range(256) r(b)),
{name}_at AS (
  SELECT 0 AS away, b, c FROM {name}_t
  UNION ALL SELECT a.away + 1, a.b, xor(a.c >> 8, t.c) FROM {name}_at a JOIN {name}_t t ON t.b = a.c & 255
  WHERE a.away < (SELECT max(octet_length(encode(s))) FROM {strings})),
{name}_h AS MATERIALIZED (SELECT away, printf('%02X', b) AS b, c FROM {name}_at),
{name}_l AS (
  SELECT 0 AS size, 4294967295::BIGINT AS c
  UNION ALL SELECT l.size + 1, xor(l.c >> 8, t.c) FROM {name}_l l JOIN {name}_t t ON t.b = l.c & 255 WHERE l.size < (SELECT max(octet_length(encode(s))) FROM {strings})),
{name}_b AS (SELECT s, octet_length(encode(s)) AS size, unnest(regexp_extract_all(hex(encode(s)), '..')) AS b, unnest(range(octet_length(encode(s)) - 1, -1, -1)) AS away FROM {strings}),
{name}_x AS (SELECT s, any_value(x.size) AS size, bit_xor(h.c) AS c FROM {name}_b x JOIN {name}_h h ON h.away = x.away AND h.b = x.b GROUP BY s),
{name} AS MATERIALIZED (SELECT s, xor(xor(x.c, l.c), 4294967295) AS crc FROM {name}_x x JOIN {name}_l l USING (size))"""


OP11 = r"""
WITH RECURSIVE
w AS (
  SELECT k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM (SELECT row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text FROM benchmark)),
f AS MATERIALIZED (
  SELECT k, unnest(w) AS s FROM w
  UNION ALL SELECT k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1),
d AS MATERIALIZED (SELECT DISTINCT s FROM f),
""" + crc32_sql("d", "code") + r""",
c AS MATERIALIZED (SELECT k, crc % 10000 AS bucket, count(*) AS n FROM f JOIN code USING (s) GROUP BY ALL),
a AS (SELECT sum(n) FILTER (k > 0) AS all_s, sum(n) FILTER (k < 0) AS all_t FROM c),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce(all_s, 0) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(all_t, 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT bucket, sum(n) FILTER (k > 0) AS s, sum(n) FILTER (k < 0) AS t FROM c GROUP BY bucket), a),
m AS (SELECT k, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM c JOIN g USING (bucket) WHERE k > 0 GROUP BY k),
v AS (
  SELECT k, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END, 0) AS weight,
    ('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h
  FROM w LEFT JOIN m USING (k) WHERE k > 0),
x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM v),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank
FROM x LEFT JOIN r USING (k)
"""

OP13 = r"""
WITH RECURSIVE
o AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS p, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
q AS MATERIALIZED (SELECT p, w, count(*) AS n FROM o WHERE len(w) >= 6 GROUP BY ALL),
d AS MATERIALIZED (SELECT DISTINCT p || w AS s FROM q),
""" + crc32_sql("d", "code") + r""",
e AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(w, 1, (crc % len(w))::BIGINT) || substr(w, (crc % len(w) + 2)::BIGINT) ELSE w END AS word, n FROM q JOIN code ON code.s = q.p || q.w),
t AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM e WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
z AS MATERIALIZED (SELECT word, unnest(range(1, len(word) + 1)) AS i, unnest(list_transform(range(1, len(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) AS v FROM t),
near AS (
  SELECT x.word AS a, y.word AS b FROM z x JOIN z y ON x.v = y.v AND x.i = y.i AND x.word <> y.word
  UNION SELECT z.word, t.word FROM z JOIN t ON z.v = t.word
  UNION SELECT t.word, z.word FROM z JOIN t ON z.v = t.word),
best AS (SELECT a AS word, count(*) AS n_near, min((-t.n, b)) AS m FROM near JOIN t ON t.word = b GROUP BY a),
form AS (SELECT t.word, t.n, coalesce(n_near, 0) AS n_near, CASE WHEN -m[1] >= 5 * t.n THEN m[2] END AS form, CASE WHEN -m[1] >= 5 * t.n THEN -m[1] END AS form_n FROM t LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root FROM form UNION ALL SELECT up.word, f.form FROM up JOIN form f ON f.word = up.root WHERE f.form IS NOT NULL),
last AS (SELECT up.word, up.root FROM up JOIN form f ON f.word = up.root WHERE f.form IS NULL)
SELECT word, n, CAST(n_near AS BIGINT) AS n_near, form, CAST(form_n AS BIGINT) AS form_n, root FROM form JOIN last USING (word)
"""
