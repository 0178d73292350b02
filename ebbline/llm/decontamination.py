"""Benchmark decontamination with a broadcast hash set of test n-grams; DataFrame operations only.

One scan: each document's windows are hashed inside the row, exploded beside one row that carries
the word count, and probed against the broadcast windows; a hit is verified word by word in the same
join.  Only hits and one small row per document are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import fresh, new_folder, store

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Test windows per broadcast (some 200 bytes each); a larger test set is probed in several scans.
BROADCAST_WINDOWS = 200_000


def words(text: str) -> Column:
    """Words of the text with A-Z lower-cased; none for null."""
    lowered = F.translate(F.col(text), UPPER, LOWER)
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def test_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, size, gram, code): every distinct window of the test items; a short item is one window."""
    listed = items.select(F.col(item_id).cast("string").alias("item"), words(text).alias("w")).filter(F.size("w") > 0)
    sized = listed.withColumn("size", F.least(F.size("w"), F.lit(window)))
    grams = sized.select("item", "size", F.explode(F.expr("transform(sequence(1, size(w) - size + 1), i -> slice(w, i, size))")).alias("gram"))
    return grams.distinct().withColumn("code", F.xxhash64(F.transform("gram", lambda w: F.xxhash64(w))))


def hits(docs: DataFrame, grams: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row per distinct key: n_words, copies (input rows), runs (place, size) and items that occur."""
    grams = store(grams, new_folder(docs.sparkSession, "windows"), "grams")
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # ten at most
    blocks = max(1, -(-grams.count() // BROADCAST_WINDOWS))
    sides = [grams.filter(F.pmod("code", F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [grams]
    found = reduce(DataFrame.unionAll, [_probe(docs, side, sizes, key, text, first=b == 0) for b, side in enumerate(sides)])
    return found.groupBy(*key).agg(
        F.max("n_words").alias("n_words"), F.sum(F.when(F.col("place") == 0, 1)).alias("copies"),
        F.collect_set(F.when(F.col("place") > 0, F.struct("place", "size"))).alias("runs"),
        F.collect_set("item").alias("items"),
    )


def _probe(docs: DataFrame, grams: DataFrame, sizes: list[int], key: list[str], text: str, first: bool) -> DataFrame:
    """Rows of place 0 (one per document, in the first scan) and rows of verified hits."""
    codes = ", ".join(
        f"transform(sequence(1, greatest(size(w) - {n} + 1, 1)), i -> struct(i AS place, {n} AS size, xxhash64(slice(h, i, {n})) AS code))"
        for n in sizes
    )
    own = "array(struct(0 AS place, 0 AS size, 0L AS code))"
    listed = docs.select(*key, words(text).alias("w")).withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))  # a word is hashed once
    rows = listed.select(*key, "w", F.explode(F.expr(f"concat({own}{', ' + codes if codes else ''})")).alias("p")).select(*key, "w", "p.*")
    side = F.broadcast(grams.select(F.col("code").alias("__code"), F.col("size").alias("__size"), "gram", "item"))
    same = (F.col("code") == F.col("__code")) & (F.col("size") == F.col("__size")) & (F.slice("w", F.greatest("place", F.lit(1)), F.greatest("size", F.lit(1))) == F.col("gram"))
    joined = rows.join(side, same, "left" if first else "inner")
    if first:
        joined = joined.filter((F.col("place") == 0) | F.col("item").isNotNull())
    return joined.select(*key, F.when(F.col("place") == 0, F.size("w")).alias("n_words"), "place", "size", "item")


#: Words under any of the runs, which are sorted by place: each adds what reaches beyond the words so far.
COVERED = """aggregate(array_sort(runs), struct(0L AS done, 0L AS n),
    (a, r) -> struct(greatest(a.done, CAST(r.place + r.size - 1 AS BIGINT)) AS done,
                     a.n + greatest(0L, r.place + r.size - 1 - greatest(a.done, r.place - 1L)) AS n), a -> a.n)"""


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, one row per input row.

    A null text has no words, and so has one without a letter or digit; an item without words has no
    window.  Rows that repeat an id count apart when their texts differ; equal rows give equal rows.
    Without items nothing is contaminated.  A null id is an id like others.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("__hash"))
    found = hits(keyed, test_windows(items, window=window), ["doc_id", "__hash"])
    counted = found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.expr(COVERED).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        F.explode(F.expr("sequence(1L, copies)")).alias("__copy"),
    )
    return counted.drop("__copy").withColumn("contaminated", F.col("n_hit") > 0)


def remove(
    docs: DataFrame, items: DataFrame, mode: str = "documents", doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """The input's columns without what the test items contaminate.

    ``documents`` leaves out every contaminated row; ``spans`` keeps all rows and takes the words
    under a hit out of the text (what stands between words stays).  Words that come together where a
    hit was taken out can form a window that the given text did not have; it stays.  Other rows and
    columns stay as they are, whatever their names, nulls and repeated rows included.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode}")
    own, other, ident, runs, found_words, gaps = fresh(docs, "hash", "same", "id", "runs", "words", "gaps")
    keyed = docs.withColumn(own, F.xxhash64(text))
    found = hits(
        keyed.select(F.col(doc_id).alias(ident), F.col(text).alias("text"), F.col(own).alias(other)),
        test_windows(items, window=window), [ident, other],
    ).filter(F.size("runs") > 0).select(ident, other, F.col("runs").alias(runs))
    match = F.col(doc_id).eqNullSafe(F.col(ident)) & (F.col(own) == F.col(other))
    if mode == "documents":
        return keyed.join(found, match, "left_anti").select(*docs.columns)
    marked = keyed.join(found, match, "left").withColumns({
        found_words: F.regexp_extract_all(text, F.lit(ANY_CASE_WORD), F.lit(0)), gaps: F.split(text, ANY_CASE_WORD, -1),
    })
    kept = f"transform({found_words}, (w, i) -> if(exists({runs}, r -> i + 1 BETWEEN r.place AND r.place + r.size - 1), '', w))"
    rebuilt = F.expr(f"array_join(zip_with({gaps}, {kept}, (g, w) -> concat(coalesce(g, ''), coalesce(w, ''))), '')")
    clean = F.when(F.col(runs).isNull(), F.col(text)).otherwise(rebuilt)
    return marked.withColumn(text, clean).select(*docs.columns)
