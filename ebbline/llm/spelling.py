"""Spelling variants: words one edit apart, found by pivotal grams; each word's commoner form and its root.

Bigrams of the words have one global order, rare ones first.  A word's prefix is its three first grams
(and all equal to the third); its pivots are two disjoint grams of the prefix, the rarest pair, chosen
by dynamic programming.  One edit spoils one of two disjoint grams at most, so of two near words the
one whose prefix ends earlier has a pivot among the other's prefix.

Position limits: the edit is behind the first pivot, which then lies at the same place behind the same
beginning, or it is before the second pivot, which then lies at the same distance from the end in front
of the same ending.  A pivot is looked up with its beginning or ending, so few words meet; what meets is
verified.  A crowded beginning or ending is cut further, without loss, by deletion variants: near words
share one, and only some 90 words per letter can share the same one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import byte_groups, new_folder, ship_package, store

LETTERS = r"A-Za-zÀ-ÿ"
#: Deleted characters: one word occurrence in so many documents loses one, by a hash.
SLIP = 199
#: Distinct words a task gathers before it hands them on.
HELD_WORDS = 200_000
#: Words on one side of a lookup key; above, deletion variants are part of the key.
CROWDED = 64


def count_words(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, slip: int | None = SLIP,
) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of ``least_length`` code points or more, and how often they occur.

    ``slip``: where it divides the crc32 of ``<key>:<run>``, the run loses the code point at that number
    modulo its length (None: never).  A null key counts as an empty one.  Tasks sum before the shuffle.
    """
    ship_package(docs.sparkSession)
    runs, schema = re.compile(f"[{LETTERS}]{{{least_length},}}"), pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], schema=schema)

        for batch in batches:
            for part in byte_groups(batch, 1, 1 << 20):
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not t:
                        continue
                    start = zlib.crc32(f"{k}:".encode())
                    for w, n in Counter(runs.findall(t.encode().lower().decode())).items():
                        if slip:
                            h = zlib.crc32(w.encode(), start)
                            if h % slip == 0:
                                at = h % len(w)
                                w = w[:at] + w[at + 1 :]
                                if len(w) < least_length:
                                    continue
                        found[w] += n
                if len(found) > HELD_WORDS:
                    yield out()
                    found.clear()
        if found:
            yield out()

    source = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).cast("string").alias("t"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pivots(grams: list[tuple[int, int]]) -> tuple[int, int]:
    """Places of two disjoint grams of least summed rank; grams: (place, rank) by place, the outermost two disjoint."""
    best, chosen = None, (0, 0)
    cheapest, behind = None, 0  # cheapest (rank, place) that lies two places back or more
    for place, rank in grams:
        while grams[behind][0] <= place - 2:
            cheapest = min(cheapest or (grams[behind][1], grams[behind][0]), (grams[behind][1], grams[behind][0]))
            behind += 1
        if cheapest and (best is None or cheapest[0] + rank < best):
            best, chosen = cheapest[0] + rank, (cheapest[1], place)
    return chosen


def signature(word: str, rank: dict[str, int]) -> tuple[int, list[int], tuple[int, int]]:
    """The rank at which the prefix ends, the places of the prefix's grams, and of the two pivots (from 1)."""
    ranks = [rank[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(ranks)[2]
    prefix = [(i + 1, r) for i, r in enumerate(ranks) if r <= last]
    return last, [i for i, _ in prefix], pivots(prefix)


def lookups(words: DataFrame) -> DataFrame:
    """(word, size, last, pivot, key): lookup keys of each word's pivots and of its prefix.

    The ranks on the driver are bounded by the letters: 90 of them have 8,100 bigrams.
    """
    grams = words.select(F.explode(F.expr("transform(sequence(1, char_length(word) - 1), i -> substring(word, i, 2))")).alias("g"))
    counted = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()
    rank = {r["g"]: k for k, r in enumerate(sorted(counted, key=lambda r: (r["n"], r["g"])))}
    shared = words.sparkSession.sparkContext.broadcast(rank)
    schema = pa.schema([("word", pa.string()), ("last", pa.int32()), ("prefix", pa.list_(pa.int32())), ("first", pa.int32()), ("second", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for batch in batches:
            some = batch.column(0).to_pylist()
            found = [signature(w, rank) for w in some]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.string()), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.list_(pa.int32())),
                pa.array([f[2][0] for f in found], pa.int32()), pa.array([f[2][1] for f in found], pa.int32()),
            ], schema=schema)

    signed = words.select("word").mapInArrow(run, "word string, last int, prefix array<int>, first int, second int")
    sides = F.expr("""concat(
        array(struct(true AS pivot, xxhash64(0, substring(word, 1, first + 1)) AS key), struct(true AS pivot, xxhash64(1, substring(word, second)) AS key)),
        transform(prefix, i -> struct(false AS pivot, xxhash64(0, substring(word, 1, i + 1)) AS key)),
        transform(prefix, i -> struct(false AS pivot, xxhash64(1, substring(word, i)) AS key)))""")
    return signed.select("word", F.char_length("word").alias("size"), "last", F.explode(sides).alias("s")).select("word", "size", "last", "s.*")


def near_pairs(words: DataFrame, folder: str) -> DataFrame:
    """(a, b), both ways: the pairs of different words that are one edit apart."""
    keyed = store(lookups(words), folder, "lookups")
    met = keyed.groupBy("key").agg(F.sum(F.col("pivot").cast("long")).alias("n_pivots"), F.sum((~F.col("pivot")).cast("long")).alias("n_prefixes"))
    # a word's own prefix is always there, so a pivot needs one more
    met = met.filter("n_pivots > 0 AND n_prefixes > 1").select("key", (F.greatest("n_pivots", "n_prefixes") > CROWDED).alias("crowded"))
    variants = F.expr("""CASE WHEN crowded THEN concat(array(xxhash64(word)),
        transform(sequence(1, size), i -> xxhash64(concat(substring(word, 1, i - 1), substring(word, i + 1))))) ELSE array(0L) END""")
    cut = keyed.join(met, "key").select("key", F.explode(F.array_distinct(variants)).alias("slot"), "word", "size", "last", "pivot")
    cut = store(cut, folder, "cut")
    p = cut.filter("pivot").select("key", "slot", F.col("word").alias("a"), F.col("size").alias("a_size"), F.col("last").alias("a_last"))
    s = cut.filter("NOT pivot").select("key", "slot", F.col("word").alias("b"), F.col("size").alias("b_size"), F.col("last").alias("b_last"))
    close = "a_last <= b_last AND abs(a_size - b_size) <= 1 AND a <> b"
    found = p.join(s, ["key", "slot"]).filter(close).filter(F.levenshtein("a", "b", 1) == 1).select("a", "b")
    return store(found.unionAll(found.select("b", "a")).distinct(), folder, "near")


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) for words with a form: the end of the chain of forms, by doubling; chains are as long as a logarithm of n."""
    at, turn = store(forms.select("word", F.col("form").alias("root")), folder, "roots0"), 0
    while True:
        turn += 1
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = store(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), folder, f"roots{turn}")
        at = stepped.select("word", "root")
        if stepped.filter("moved").limit(1).count() == 0:
            return at


def group_variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, factor: int = 5, slip: int | None = SLIP,
) -> DataFrame:
    """word, n, n_near, form, form_n, root: the words of at least ``least_count`` occurrences and their commoner spellings.

    n_near counts the words one edit away (an inserted, deleted or replaced code point).  form is the
    one of largest n among them, ties to the smallest in code-point order, if its n is at least
    ``factor`` times the word's; root is the end of the chain of forms, the word itself without one.

    Null and empty texts have no words; repeated rows count each; a null key counts as an empty one;
    an empty table gives an empty one.  Other columns play no part.
    """
    if least_length < 4:
        raise ValueError("two disjoint bigrams need at least three grams, that is four letters")
    folder = new_folder(docs.sparkSession, "spelling")
    words = store(count_words(docs, key, text, least_length, slip).filter(F.col("n") >= least_count), folder, "words")
    near = near_pairs(words, folder).join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("b"))).alias("best"))
    common = -F.col("best.m") >= factor * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best.b")).alias("form"), F.when(common, -F.col("best.m")).alias("form_n"),
    )
    formed = store(formed, folder, "forms")
    ends = roots(formed.filter("form IS NOT NULL"), folder)
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
