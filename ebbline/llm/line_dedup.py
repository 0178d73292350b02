"""Repeated runs of lines: a suffix array over line ids by prefix doubling, then longest earlier matches.

The sequence is that of all documents' non-blank lines, by (doc_id, text hash, line); only lines that
occur twice or more are kept in it, as a run ends at any other line.  Each round of doubling refines
the rank of suffixes by their first 2^k lines; suffixes of equal rank are an LCP interval of depth
2^k or more.  A descent over the stored rounds then finds, for every suffix, how many of its lines an
earlier suffix starts with too: within the interval of the longest power of two, intervals of half the
length follow.  Each row is handled on its own; no group is gathered, and the hot ones are summed
before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.llm.common import byte_groups, fresh, new_folder, store

#: A repeated run counts from so many words on.
MIN_WORDS = 50


def with_offsets(df: DataFrame, order: list[str], amount: str, folder: str, name: str) -> DataFrame:
    """Adds ``offset``: the sum of ``amount`` over all rows before, in the order given.

    Rows are dealt in ranges of the order; the driver sees one sum per range.
    """
    dealt = store(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), folder, name)
    sums, total = [], 0
    for r in dealt.groupBy("part").agg(F.sum(amount).alias("s")).orderBy("part").collect():
        sums.append((r["part"], total))
        total += r["s"]
    begins = F.broadcast(dealt.sparkSession.createDataFrame(sums, "part int, begin long"))
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(begins, "part").withColumn("offset", F.col("begin") + F.coalesce(F.sum(amount).over(before), F.lit(0))).drop("part", "begin")


def listed(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, n_lines, seq, h1, h2, words, before): one row per non-blank line; docs has doc_id, hash, text."""
    words = "(length(trim(x)) - length(replace(trim(x), ' ', '')) + 1)"
    kept = F.expr("filter(split(text, '\\n', -1), x -> trim(x) <> '')")
    lines = docs.select("doc_id", "hash", kept.alias("lines")).select(
        "doc_id", "hash", F.size("lines").cast("long").alias("n_lines"),
        F.posexplode(F.expr(f"transform(lines, x -> struct(xxhash64(x) AS h1, xxhash64(x, 1) AS h2, {words} AS words))")).alias("seq", "l"),
    )
    return lines.select("doc_id", "hash", "n_lines", F.col("seq").cast("long").alias("seq"), "l.*")


def live_lines(docs: DataFrame, folder: str) -> DataFrame:
    """(p, rank, n, words, doc_id, hash, seq): lines that occur twice or more, at their place in the sequence.

    Places of a document follow each other, and one is left free behind each document; so p + 1 is
    the next line or none.  Rank: how many lines of the sequence are less, by the line's hash.
    """
    lines = store(listed(docs), folder, "lines")
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = with_offsets(counts, ["h1", "h2"], "n", folder, "line_counts").withColumnRenamed("offset", "rank")
    live = store(lines.join(ranked, ["h1", "h2"]).drop("h1", "h2").dropDuplicates(["doc_id", "hash", "seq"]), folder, "live_lines")
    sizes = live.groupBy("doc_id", "hash").agg((F.max("n_lines") + 1).alias("room"))
    placed = with_offsets(sizes, ["doc_id", "hash"], "room", folder, "rooms").withColumnRenamed("offset", "start")
    same = F.col("live.doc_id").eqNullSafe(F.col("placed.doc_id")) & (F.col("live.hash") == F.col("placed.hash"))
    joined = live.alias("live").join(placed.alias("placed"), same)
    rows = joined.select((F.col("start") + F.col("seq")).alias("p"), "rank", "n", "words", "live.doc_id", "live.hash", "seq")
    return store(rows, folder, "live")


def doubled(live: DataFrame, folder: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rounds of doubling: for each k the suffixes (p, rank) whose first 2^k lines another has, and all settled ones.

    Rank: how many suffixes are less by their first 2^k lines.  A suffix that leaves the live lines
    ends in a mark of its own, less than all lines, by place.
    """
    active, settled, levels, size = store(live.filter("n > 1").select("p", "rank"), folder, "rank0"), [], [], 1
    settled.append(live.filter("n = 1").select("p", "rank"))
    while not active.isEmpty():
        levels.append(active)
        known = reduce(DataFrame.unionAll, settled, active).select(F.col("p").alias("q"), F.col("rank").alias("then"))
        two = active.join(known, F.col("p") + size == F.col("q"), "left").select("p", "rank", F.coalesce("then", -F.col("p") - 1).alias("then"))
        two = store(two, folder, f"pairs{len(levels)}")
        counts = two.groupBy("rank", "then").agg(F.count("*").alias("n"))
        before = Window.partitionBy("rank").orderBy("then").rowsBetween(Window.unboundedPreceding, -1)
        refined = counts.withColumn("next", F.col("rank") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        result = store(two.join(refined, ["rank", "then"]).select("p", F.col("next").alias("rank"), "n"), folder, f"rank{len(levels)}")
        active, size = result.filter("n > 1").select("p", "rank"), 2 * size
        settled.append(result.filter("n = 1").select("p", "rank"))
    return levels, settled


def suffix_array(live: DataFrame, folder: str) -> DataFrame:
    """(p, rank): every live suffix and its place in the sorted order."""
    return reduce(DataFrame.unionAll, doubled(live, folder)[1])


def earlier_matches(levels: list[DataFrame], folder: str) -> DataFrame:
    """(p, length): suffixes that start with lines an earlier suffix starts with, and how many at most.

    Rows (p, first, length, asks) are members of the set of suffixes that share ``length`` lines with
    the suffix ``first``.  At level k a set falls into subsets by the next 2^k lines.  Who is not the
    first of the subset goes on in it.  The first stays in the set, to try fewer lines, and serves the
    subset as an earlier place (asks is false then).  In the set the firsts stand for their subsets.
    """
    if not levels:
        raise ValueError("no level")
    rows = store(levels[0].select("p", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("length"), F.lit(True).alias("asks")), folder, "sets")
    for k in range(len(levels) - 1, -1, -1):
        named = levels[k].select(F.col("p").alias("q"), F.col("rank").alias("name"))
        seen = store(rows.join(named, F.col("p") + F.col("length") == F.col("q"), "left").drop("q"), folder, f"seen{k}")
        subsets = seen.filter("name IS NOT NULL").groupBy("first", "length", "name").agg(F.min("p").alias("least"), F.count("*").alias("n"))
        both = seen.join(subsets, ["first", "length", "name"], "left").withColumn("alone", F.coalesce("n", F.lit(1)) == 1)
        is_first = F.col("alone") | (F.col("p") == F.col("least"))
        step = F.when(~F.col("alone"), F.struct(F.col("least").alias("first"), (F.col("length") + (1 << k)).alias("length"), (F.col("asks") & ~is_first).alias("asks")))
        stay = F.when(is_first, F.struct("first", "length", "asks"))
        moved = both.select("p", F.explode(F.array_compact(F.array(step, stay))).alias("m")).select("p", "m.*")
        rows = store(moved, folder, f"sets{k}")
    return rows.filter("asks AND length > 0").select("p", "length")


def repeated_runs(docs: DataFrame, min_words: int, folder: str) -> DataFrame:
    """(doc_id, hash, runs): per document the runs (seq, length) of lines that are copies of earlier ones."""
    live = live_lines(docs, folder)
    levels, _ = doubled(live, folder)
    empty = live.limit(0).select("doc_id", "hash", F.array(F.struct("seq", F.col("n").alias("length"))).alias("runs"))
    if not levels:
        return empty
    found = earlier_matches(levels, folder)
    total = with_words(live, docs.sparkSession, folder)
    ends = total.select((F.col("p") + 1).alias("stop"), F.col("through"))
    starts = total.select("p", "doc_id", "hash", "seq", (F.col("through") - F.col("words")).alias("before"))
    runs = found.join(starts, "p").withColumn("stop", F.col("p") + F.col("length")).join(ends, "stop")
    runs = runs.filter(F.col("through") - F.col("before") >= min_words)
    return runs.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("seq", "length")).alias("runs"))


def with_words(live: DataFrame, spark, folder: str) -> DataFrame:
    """Adds ``through``: words of the document's live lines up to and with this one (a run has only live lines)."""
    upto = Window.partitionBy("doc_id", "hash").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return store(live.withColumn("through", F.sum("words").over(upto)), folder, "words")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The input's columns, its text without later copies of runs of lines, and n_lines and n_removed.

    A run: consecutive non-blank lines, longest possible, of ``min_words`` words or more (parts between
    single spaces), that stands at an earlier place too: in a document of lesser id, or before in the
    same one; copies may overlap.  The first stays.  Blank lines stay as they are.  A null text stays
    null, an empty one empty, with 0 lines.  A null id comes before others.  Rows that repeat an id
    and a text count as one document and have equal results; of an id with several texts each text is
    a document, ordered by hash.  Input columns named n_lines or n_removed give way.  Lines are known
    by 128-bit hashes.
    """
    folder = new_folder(docs.sparkSession, "lines")
    given = docs.drop("n_lines", "n_removed")
    own, other, ident, spans_of = fresh(given, "hash", "same", "id", "runs")
    keyed = given.withColumn(own, F.xxhash64(text))
    named = keyed.select(F.col(doc_id).alias("doc_id"), F.col(own).alias("hash"), F.col(text).alias("text"))
    runs = repeated_runs(named, min_words, folder).select(F.col("doc_id").alias(ident), F.col("hash").alias(other), F.col("runs").alias(spans_of))
    match = F.col(doc_id).eqNullSafe(F.col(ident)) & (F.col(own) == F.col(other))
    joined = keyed.join(runs, match, "left").select(*given.columns, spans_of)
    at, width = given.columns.index(text), len(given.columns)
    schema = T.StructType([*given.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_groups(batch, at, 8 << 20):
                texts, sizes, gone = [], [], []
                for body, spans in zip(part.column(at).to_pylist(), part.column(width).to_pylist()):
                    body, size, removed = without(body, [(s["seq"], s["length"]) for s in spans or ()])
                    texts.append(body)
                    sizes.append(size)
                    gone.append(removed)
                columns = [*part.columns[:-1], pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())]
                columns[at] = pa.array(texts, part.column(at).type)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(rebuild, schema)


def without(text: str | None, runs: list[tuple[int, int]]) -> tuple[str | None, int, int]:
    """The text without the runs' lines, how many non-blank lines it had, and how many went."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    places = [k for k, line in enumerate(lines) if line.strip(" ")]
    gone, done = set(), 0
    for start, length in sorted(runs):
        gone.update(places[max(start, done) : start + length])
        done = max(done, start + length)
    if not gone:
        return text, len(places), 0
    return "\n".join(line for k, line in enumerate(lines) if k not in gone), len(places), len(gone)
