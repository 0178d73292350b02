"""Exact Jaccard join on word shingles with prefix filters under several global token orders.

A pair with similarity t shares a token of the first ``n - ceil(t n) + 1`` of each set under any one
order of all tokens.  Orders used: token hash (a first filter on documents), frequency (rare first:
makes the candidates), hash from the other end (joins the hash order in sifting candidates before
they are verified).  Equal sets are one node from the start.

Candidates of a token do not become all pairs: first every set meets the token's lead, the set with
the smallest share of tokens that no other has (of a group of edited copies, the one edited least);
verified links join into components, and only pairs across components are formed then.  Of those a
set meets sets of about its size alone, and sets whose place of the token only leaves room for
smaller partners (those that share a passage and have too much of their own) never meet each other.
What a token's rows need of the whole group is summed by token and joined back, so a hot token is no
window of one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.common import fresh, map_texts, new_folder, store
from ebbline.llm.components import connected

WORDS = 5
#: Two sets link when 100 * |both| >= PERCENT * |either|.
PERCENT = 80
#: Words a worker keeps hashes of (some 200 bytes each).
REMEMBERED = 200_000
#: Texts of sets that may link are found by a broadcast of their 64-bit hashes up to so many (some 60
#: bytes each); beyond that all texts are shuffled to them.
BROADCAST_KEYS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread (splitmix64)."""
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted 64-bit hashes of a text's distinct shingles."""

    def __init__(self, words: int = WORDS, remembered: int = REMEMBERED):
        import xxhash

        self.words, self.hash, self.remembered = words, xxhash.xxh3_64_intdigest, remembered
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space only
        if not words:
            return np.zeros(0, np.int64)
        if len(self.known) > self.remembered:
            self.known.clear()
        try:
            codes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for word in set(words).difference(self.known):
                self.known[word] = self.hash(word)
            codes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        width = min(self.words, len(codes))
        found = np.full(len(codes) - width + 1, width, np.uint64)
        for k in range(width):
            found = mixed(found ^ codes[k : len(codes) - width + 1 + k])
        return np.unique(found.view(np.int64))


def prefix_size(n, percent: int = PERCENT):
    """n - ceil(t n) + 1, for numbers and columns."""
    return n - (n * percent + 99) // 100 + 1


def set_id(tokens: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(tokens.tobytes(), len(tokens)) - (1 << 63)


def sketches(docs: DataFrame, percent: int, keep: Sequence[str], text: str) -> DataFrame:
    """keep, same (hash of the text), n, node (hash of the set, null for none) and the extended prefix under the hash order.

    Extended by a quarter: linked sets then share several tokens of it (see ``needed``).
    """

    def make() -> Callable[[list[str | None]], Sequence]:
        shingle = Shingler()

        def work(texts: list[str | None]) -> Sequence:
            sets = [shingle(t) for t in texts]
            sizes = [extended(len(s), percent) for s in sets]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = np.concatenate([s[:q] for s, q in zip(sets, sizes)]) if sets else np.zeros(0, np.int64)
            return [len(s) for s in sets], [set_id(s) if len(s) else None for s in sets], pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))

        return work

    known = docs.withColumn("same", F.xxhash64(F.col(text).cast("string")))
    return map_texts(known, [*keep, "same"], text, "n long, node long, prefix array<long>", make)


def shared_least(n: int, percent: int) -> int:
    return -(-prefix_size(n, percent) // 4)


def extended(n: int, percent: int) -> int:
    return min(n, prefix_size(n, percent) + shared_least(n, percent) - 1) if n else 0


def suspects(rows: DataFrame, percent: int) -> DataFrame:
    """(node, n, doc_id, same): sets that may link, by the hash order alone, each with one row that has it.

    Sets that link share, of their extended prefixes, as many tokens as the smaller one's extension
    counts; so a set needs that many tokens that another set's prefix has too.
    """
    valid = rows.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    nodes = valid.groupBy("node").agg(F.min(F.struct("doc_id", "same")).alias("row"), F.max("n").alias("n"), F.count("*").alias("copies"))
    tokens = valid.select("node", F.explode("prefix").alias("token"))
    held = tokens.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("token")
    shared = tokens.join(held, "token").groupBy("node").agg(F.count("*").alias("shared"))
    smaller = F.expr(f"(n * {percent} + 99) div 100")
    needed = F.ceil((smaller - F.expr(f"((n * {percent} + 99) div 100 * {percent} + 99) div 100") + 1) / 4)
    both = nodes.join(shared, "node").filter(F.col("shared") >= needed * F.col("copies"))  # copies of a set count out
    return both.select("node", "n", "row.doc_id", "row.same")


def token_sets(docs: DataFrame, chosen: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(node, n, tokens): the whole sets of the chosen nodes, one row each."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = texts.withColumn("same", F.xxhash64("text"))
    if chosen.count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(chosen.select("same").distinct()), "same", "left_semi")
    # rows that repeat id and text meet in one task by the join; no shuffle more
    texts = texts.join(chosen, ["doc_id", "same"]).dropDuplicates(["doc_id", "same"])

    def make() -> Callable[[list[str | None]], Sequence]:
        shingle = Shingler()

        def work(texts: list[str | None]) -> Sequence:
            sets = [shingle(t) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            return (pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64())),)

        return work

    return map_texts(texts, ["node", "n"], "text", "tokens array<long>", make)


def rare_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, alone, place): the prefix under the order (frequency, hash), tokens of two sets or more.

    Tokens that only one set has come first in its order and can match nothing; a set whose prefix has
    no others drops out.
    """
    tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    counted = tokens.join(common, "token")
    gathered = counted.groupBy("node").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("common"))
    alone = "n - size(common)"
    size = f"n - (n * {percent} + 99) div 100 + 1"
    cut = gathered.select("node", "n", F.expr(alone).alias("alone"), F.expr(f"slice(common, 1, CAST(greatest({size} - ({alone}), 0) AS INT))").alias("first"))
    return cut.select("node", "n", "alone", F.posexplode("first").alias("at", "t")).select(F.col("t.token").alias("token"), "node", "n", "alone", (F.col("alone") + F.col("at")).alias("place"))


def possible(percent: int) -> str:
    """Sizes a and b can link, and enough tokens follow the common one (a, b: n and place).

    The second part holds at the first token that a linked pair has in common, which is in both
    prefixes; so a linked pair passes at one token at least.
    """
    overlap = f"({percent} * (an + bn) + {99 + percent}) div {100 + percent}"
    return f"an * 100 >= bn * {percent} AND bn * 100 >= an * {percent} AND least(an - aplace, bn - bplace) >= {overlap}"


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: sifted by two more orders, then counted."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("at"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("bt"))
    full = pairs.select("a", "b").join(left, "a").join(right, "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in range(4)]
            flats = [np.asarray(c.flatten()) for c in columns[2:]]
            bounds = [np.concatenate([[0], np.cumsum(np.asarray(c.value_lengths()))]) for c in columns[2:]]
            good = []
            for k in range(len(batch)):
                x, y = (f[b[k] : b[k + 1]] for f, b in zip(flats, bounds))
                p, q = prefix_size(len(x), percent), prefix_size(len(y), percent)
                if common(x[:p], y[:q]) and common(x[len(x) - p :], y[len(y) - q :]):
                    both = common(x, y)
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        good.append(k)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(good, pa.int64())) for c in columns[:2]], names=["a", "b"])

    return full.select("a", "b", "at", "bt").mapInArrow(check, "a long, b long")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


#: Sizes that differ by this factor or less are in the same band or in neighbouring ones.
BAND = "CAST(floor(ln(n) / ln(100D / {percent})) AS INT)"


def partners(rows: DataFrame, percent: int) -> DataFrame:
    """Adds ``band`` (of the size), and ``equal``: whether the token's place leaves room for a partner as large as the set.

    A partner of size m needs ``possible``'s overlap from the place on; where that rules out m >= n, the
    set's partners are all smaller.  Two such sets cannot be partners of each other.
    """
    overlap = f"({percent} * 2 * n + {99 + percent}) div {100 + percent}"
    return rows.withColumns({"band": F.expr(BAND.format(percent=percent)) if percent < 100 else F.col("n").cast("int"), "equal": F.expr(f"n - place >= {overlap}")})


def across(few: DataFrame, rest: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of a set of ``few`` and one of ``rest`` at a token, of other components, that may link."""
    few = partners(few, percent).select(
        "token", F.col("node").alias("a"), F.col("n").alias("an"), F.col("place").alias("aplace"), F.col("root").alias("aroot"), F.col("equal").alias("aequal"),
        F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"))
    rest = partners(rest, percent).select(
        "token", "band", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("place").alias("bplace"), F.col("root").alias("broot"), "in_main", F.col("equal").alias("bequal"))
    # those with room for equal partners meet all of their sizes, the others only those with room
    roomy = few.filter("aequal").join(rest, ["token", "band"])
    tight = few.filter("NOT aequal").join(rest.filter("bequal"), ["token", "band"])
    return roomy.unionByName(tight).filter(f"aroot <> broot AND (in_main OR a < b) AND {possible(percent)}").select("a", "b")


def link(buckets: DataFrame, sets: DataFrame, percent: int, folder: str) -> DataFrame:
    """(a, b): verified links that connect all that link, not every pair of a tight group."""
    leads = buckets.groupBy("token").agg(F.min(F.struct((F.col("alone") / F.col("n")).alias("own"), "node", "n", "place")).alias("lead"))
    near = buckets.join(leads, "token").filter("lead.node <> node").select(
        F.col("node").alias("b"), F.col("n").alias("bn"), F.col("place").alias("bplace"), F.col("lead.node").alias("a"), F.col("lead.n").alias("an"), F.col("lead.place").alias("aplace"))
    pairs = store(near.filter(possible(percent)).select("a", "b").distinct(), folder, "lead_pairs")
    links = store(verified(pairs, sets, percent), folder, "lead_links")
    roots = connected(links)
    placed = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("token")
    ends = store(placed.join(ends, "token").select("token", "node", "n", "place", "root"), folder, "across")
    sizes = ends.groupBy("token", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("token").agg(F.max(F.struct("size", "root"))["root"].alias("main"))
    tagged = ends.join(main, "token").withColumn("in_main", F.col("root") == F.col("main"))
    cross = across(tagged.filter("NOT in_main"), tagged, percent)
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = store(cross.join(known, ["a", "b"], "left_anti"), folder, "cross_pairs")
    return links.unionAll(store(verified(more, sets, percent), folder, "cross_links"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reached by links), one row per input row.

    A null text, or one without words, has no shingles and links with nothing.  Equal texts link.  A
    row without id keeps a null component and links nothing.  Rows that repeat an id are nodes by
    their texts.  Sets and shingles are known by 64-bit hashes.
    """
    folder = new_folder(docs.sparkSession, "jaccard")
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = store(sketches(named, percent, ["doc_id"], "text"), folder, "sketches")
    chosen = store(suspects(rows, percent), folder, "suspects")
    sets = store(token_sets(named, chosen, "text", "doc_id"), folder, "sets")
    buckets = store(rare_prefixes(sets, percent), folder, "buckets")
    links = link(buckets, sets, percent, folder)
    nodes = rows.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = nodes.join(connected(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.select("node", "root").join(named, "root").select("node", "component_id")
    joined = rows.select("doc_id", F.col("n").alias("n_shingles"), "node").join(members, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The input's rows without those whose component has a lesser id; rows without id stay.

    Of rows that repeat an id and a text one stays.
    """
    (gone,) = fresh(docs, "gone")
    found = classes(docs, doc_id, text, percent).filter("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, F.col(doc_id) == F.col(gone), "left_anti")
