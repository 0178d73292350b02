"""Operators that compare rows: decontamination, search, near duplicates, line runs, archives, pipeline."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ebbline.llm import block_search, decontamination, jaccard_join, line_dedup, warc
from ebbline.llm.common import new_folder
from ebbline.llm.components import connected
from ebbline.llm.queries import oracle_sql, queries
from tests.llm.conftest import ODD
from tools.compare import compare, connect

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, sf, name):
    status, n, detail = compare(spark, connect(sf), sf, queries()[name], oracle_sql()[name])
    assert status == "ok" and n > 0, detail


def contamination(text, items, window=10):
    words = WORD.findall((text or "").translate(ASCII_LOWER))
    hit, found = set(), set()
    for item, body in items:
        parts = WORD.findall((body or "").translate(ASCII_LOWER))
        size = min(window, len(parts))
        grams = {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


ITEMS = [(1, "the CAT sat on the mat"), (2, "on the mat"), (3, ""), (4, None), (5, " ... "), (10, "dolor lorem " * 8), (11, "été"), (12, "on the mat")]


def test_contamination_of_odd_rows(shipped, odd, nothing, monkeypatch):
    items = shipped.createDataFrame(ITEMS, "item_id long, text string")
    for most in (200_000, 3):  # one broadcast, several
        monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", most)
        rows = decontamination.report(odd, items).collect()
        want = sorted((d or 0, *contamination(t, ITEMS)) for d, t, _, _ in ODD)
        assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in rows) == want
    assert decontamination.report(nothing, items).count() == 0
    assert not decontamination.report(odd, items.limit(0)).filter("contaminated").count()


def test_removal_of_documents_and_spans(shipped, odd):
    items = shipped.createDataFrame(ITEMS, "item_id long, text string")
    clash = odd.withColumns({c: F.lit(1) for c in ("runs", "item", "hash", "__hash", "same", "id", "words", "gaps", "Place")})
    kept = decontamination.remove(clash, items)
    assert kept.columns == clash.columns
    # the repeated words of 9 hold "lorem dolor" in the other order only
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, t, *_ in ODD if d is not None and not contamination(t, ITEMS)[1])
    assert {r["hash"] for r in kept.collect()} == {1}
    spans = {r["doc_id"]: r["text"] for r in decontamination.remove(clash, items, mode="spans").collect()}
    assert len(spans) == len({d for d, *_ in ODD})
    assert spans[1].split() == "and then it ran away from the old dog in the yard".split()
    assert spans[2] is None and spans[3] == "" and spans[8] == "123 456 !!"
    assert not decontamination.report(decontamination.remove(odd, items, mode="spans"), items).filter("contaminated").count()


def nearest(vectors, k):
    """Query id, rank, id and score by brute force."""
    out = []
    for q, x in vectors:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), d) for d, y in vectors if d != q)[:k]
            out += [(q, rank, d, -s) for rank, (s, d) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e7])
def test_search_over_many_blocks_and_shards(shipped, monkeypatch, scale):
    monkeypatch.setattr(block_search, "SHARD_ROWS", 150)
    pick = random.Random(4)
    centres = [[pick.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [float(np.float32(scale * (c + pick.gauss(0, 0.2)))) for c in pick.choice(centres)]) for i in range(500)]
    rows += [(600 + i, rows[i][1]) for i in range(0, 60, 3)]  # ties
    odd = [(700, None), (720, [1.0, None]), (740, [float("nan")] * 6), (760, [float("inf")] * 6), (None, [1.0] * 6), rows[20]]
    df = shipped.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    codes = block_search.codes(df, "vec_id", "embedding")
    found = block_search.top_k(codes, F.col("id") % 20 == 0, k=7)
    want = nearest([(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows], 7)
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == want


def test_search_skips_blocks():
    rng = np.random.default_rng(1)
    far = [rng.normal(0, 1, (block_search.BLOCK_ROWS, 8)) + 40 * c for c in np.eye(8)]
    shard = block_search.Shard(np.arange(8 * block_search.BLOCK_ROWS), np.floor(np.vstack(far)).astype(np.int64))
    query, floor = np.floor(40 * np.eye(8)[:1]).astype(np.int64), np.array([np.iinfo(np.int64).min])
    scored = []
    starts = shard.starts
    shard.starts = type("Seen", (), {"__len__": lambda s: len(starts), "__getitem__": lambda s, k: scored.append(k) or starts[k]})()
    _, ids, scores, _ = shard.search(np.array([-1]), query, floor, 5)
    exact = np.sort(shard.codes @ query[0])[::-1][:5]
    assert len(scored) <= 2 and list(scores) == list(exact) and len(ids) == 5


def test_search_of_nothing(shipped):
    df = shipped.createDataFrame([], "vec_id long, embedding array<float>")
    assert block_search.top_k(block_search.codes(df, "vec_id", "embedding"), F.col("id") % 20 == 0).count() == 0
    one = shipped.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert block_search.top_k(block_search.codes(one, "vec_id", "embedding"), F.col("id") % 20 == 0).count() == 0


def shingle_set(text):
    words = [w for w in re.split("[ \t-\r]+", (text or "").translate(ASCII_LOWER)) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components_of(rows):
    """doc_id, set size and component of each row, comparing all pairs."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min(d, least.get(find(k), d))
    return sorted((d, len(sets[k]), least[find(k)]) for k, (d, _) in enumerate(rows))


def test_near_copies_against_all_pairs(shipped):
    pick, rows = random.Random(6), []
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [pick.choice(vocabulary) for _ in range(60)]
    for _ in range(12):
        base = [pick.choice(vocabulary) for _ in range(pick.randint(3, 160))]
        if pick.random() < 0.5:
            base += shared
        for _ in range(pick.randint(1, 14)):
            copy = list(base)
            for _ in range(pick.randint(0, max(1, len(copy) // 25))):
                copy[pick.randrange(len(copy))] = pick.choice(["edited", "changed", *vocabulary])
            rows.append((len(rows), "  ".join(copy) if pick.random() < 0.5 else "\n".join(copy).upper()))
    rows += [(900, "a b"), (901, "A  b"), (902, "a b c d e"), (903, ""), (904, " \t"), (905, None)]
    df = shipped.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "n": F.lit(2)})
    found = jaccard_join.classes(df).collect()
    assert sorted(tuple(r) for r in found) == components_of(rows)
    stay = jaccard_join.first_of_each(df)
    assert stay.columns == df.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted({c for _, _, c in components_of(rows)})


def test_one_large_group_is_not_all_pairs(shipped):
    pick = random.Random(8)
    base = [f"w{pick.randrange(5000)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        copy = list(base)
        for _ in range(pick.randint(0, 5)):
            copy[pick.randrange(300)] = f"e{pick.random()}"
        rows.append((i, " ".join(copy)))
    df = shipped.createDataFrame(rows, "doc_id long, text string")
    folder = new_folder(shipped, "large")
    sets = jaccard_join.token_sets(df, jaccard_join.suspects(jaccard_join.sketches(df, 80, ["doc_id"], "text"), 80), "text", "doc_id")
    links = jaccard_join.link(jaccard_join.rare_prefixes(sets, 80), sets, 80, folder)
    pairs = [shipped.read.parquet(f"{folder}/{n}").count() for n in ("lead_pairs", "cross_pairs")]
    texts = len({t for _, t in rows})  # equal texts are one node from the start
    assert links.count() >= texts - 1 and sum(pairs) < 10 * len(rows)
    assert sorted(tuple(r) for r in jaccard_join.classes(df).collect()) == components_of(rows)


def test_near_copies_of_odd_rows(odd, nothing):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(odd).collect()}
    assert {(1, 14, 1), (6, 14, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 1, 5), (None, 14, None), (9, 3, 9)} <= rows
    assert jaccard_join.classes(odd).count() == len(ODD)
    assert jaccard_join.classes(nothing).count() == 0


def test_components_of_chains_and_stars(shipped):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, None)]
    found = {r["node"]: r["root"] for r in connected(shipped.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def removed_lines(rows, min_words):
    """Per (id, text): how many lines of a longest earlier match of enough words it has, by trying all pairs of places."""
    texts = sorted({(d, t) for d, t in rows if t}, key=lambda x: (x[0] is not None, x[0] or 0))
    places = [(k, i, line) for k, (_, t) in enumerate(texts) for i, line in enumerate(x for x in t.split("\n") if x.strip(" "))]
    gone = {k: set() for k in range(len(texts))}
    for i, j in itertools.combinations(range(len(places)), 2):
        n = 0
        while j + n < len(places) and places[i + n][2] == places[j + n][2] and places[i + n][0] == places[i][0] and places[j + n][0] == places[j][0]:
            n += 1
        if n and sum(places[j + m][2].strip(" ").count(" ") + 1 for m in range(n)) >= min_words:
            gone[places[j][0]].update(range(places[j][1], places[j][1] + n))
    return {key: len(gone[k]) for k, key in enumerate(texts)}


def test_line_runs_against_all_places(shipped):
    pick, rows = random.Random(5), []
    base = [[f"{c}{i} x" for i in range(pick.randint(1, 9))] for c in "abcdefgh"]
    for d in range(50):
        lines = []
        for _ in range(pick.randint(1, 4)):
            lines += pick.choice(base) if pick.random() < 0.7 else [f"u{pick.random()}"]
            lines += ["", "  "] * (pick.random() < 0.3) + [lines[0]] * pick.randint(0, 4)
        rows.append((d, "\n".join(lines)))
    rows += [(90, None), (91, ""), (3, rows[3][1]), (None, rows[5][1])]
    df = shipped.createDataFrame(rows, "doc_id long, text string").withColumns({"seq": F.lit(1), "original": F.col("text"), "n_removed": F.lit("x")})
    want = removed_lines(rows, 8)
    found = line_dedup.remove_repeats(df, min_words=8).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["n_removed"] == want.get((r["doc_id"], r["original"]), 0)
        if r["original"]:
            assert r["n_lines"] == sum(bool(x.strip(" ")) for x in r["original"].split("\n"))
            assert len((r["text"] or "").split("\n")) in (len(r["original"].split("\n")) - r["n_removed"], 1)
        else:
            assert r["text"] == r["original"]


def test_suffixes_are_sorted(shipped):
    docs = shipped.createDataFrame([(k, t) for k, t in enumerate(["a\nb\na\nb\na", "b\na\nb", "a\nc", "c\na\nb\na"])], "doc_id long, text string")
    folder = new_folder(shipped, "suffixes")
    live = line_dedup.live_lines(docs.withColumn("hash", F.xxhash64("text")), folder)
    rank = {r["p"]: r["rank"] for r in live.collect()}
    order = [r["p"] for r in line_dedup.suffix_array(live, folder).orderBy("rank").collect()]
    suffix = lambda p: list(itertools.takewhile(lambda x: x is not None, (rank.get(q) for q in itertools.count(p))))
    assert sorted(order) == sorted(rank) and all(suffix(a) <= suffix(b) for a, b in zip(order, order[1:]))


def test_line_runs_of_odd_rows(odd, nothing):
    clash = odd.withColumns({c: F.lit(1) for c in ("hash", "__hash", "same", "id", "runs", "p", "Rank", "n_lines")})
    rows = line_dedup.remove_repeats(clash, min_words=10).collect()
    assert {r["hash"] for r in rows} == {1}
    assert len(rows) == len(ODD) and rows[0].asDict().keys() == {*clash.columns, "n_removed"}
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["n_removed"] == 0 and by[1]["n_removed"] == by[6]["n_removed"] == 1 and by[1]["text"] == ""
    assert by[2]["text"] is None and by[4]["text"] == "  \n\n " and by[9]["n_removed"] == 0
    assert line_dedup.remove_repeats(nothing).count() == 0
    assert line_dedup.remove_repeats(odd.limit(0)).count() == 0


PAGES = [(1, "http://a.example/", "x" * 200), (2, None, "x" * 200), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""),
         (7, "u\r\nv", "é" * 60), (9, "u", "é" * 60), (9, "u", "é" * 60), (None, "u", "x" * 200), (8, "u", "y" * 300_000)]


def test_archives_of_odd_rows(shipped):
    df = shipped.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "record_type": F.lit("z")})
    rows = warc.archive(df, archive_bytes=300).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        html = next(h for p, _, h in PAGES if p == r["page_id"]) or ""
        assert r["payload_digest"] == hashlib.sha256(html.encode()).hexdigest() and r["payload_bytes"] == len(html.encode())
        assert r["payload"] == (html.encode() if r["record_type"] == "response" else None)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in rows}
    assert kinds == {(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None),
                     (7, "response", None), (9, "revisit", 7), (None, "revisit", 1), (8, "response", None)}
    assert warc.archive(df.limit(0)).count() == 0


def test_archive_frames(shipped, tmp_path):
    """A leading skippable frame holds the dictionary; other tools can read every record with it."""
    import struct

    import zstandard

    df = shipped.createDataFrame([(i, "u", f"<html>{'common words ' * 30}{i * 7919}</html>") for i in range(400)], "page_id long, url string, html string")
    folder = f"{tmp_path}/archive"
    trained = warc.dictionary(warc.payloads(df))
    manifest = warc.write(warc.decide(df), folder, trained)
    assert trained and manifest.agg(F.sum("n_records")).first()[0] == 400
    for r in manifest.collect():
        data = open(r["path"], "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D and data[8 : 8 + size] == trained
        unpacker, rest, n = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained)), data[8 + size :], 0
        while rest:
            one = unpacker.decompressobj()
            head, body = warc.parse(one.decompress(rest))
            assert head["WARC-Type"] == "response" and b"common words" in body
            rest, n = one.unused_data, n + 1
        assert n == r["n_records"] and len(data) - 8 - size == r["n_bytes"] < 400 * n
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")


def test_pipeline_of_odd_rows(shipped, odd, nothing, tmp_path):
    folder = str(tmp_path)
    shipped.createDataFrame(ITEMS[:1], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, docs in (("odd", odd), ("nothing", nothing)):
        docs = docs.withColumns({"n_chars": F.length("text").cast("long"), "score": F.lit(1), "lang_pred": F.lit("x")})
        for k, (step, stage) in enumerate(corpus_pipeline.STAGES):
            found = stage(shipped, docs, folder)
            assert found.columns == (docs.columns if k < 4 else ["doc_id", "samples"])
            found.write.parquet(f"{folder}/{name}{k}")
            docs = shipped.read.parquet(f"{folder}/{name}{k}")
        # only doc 1's text equals others; all hold the item; no letters: 2, 3, 4, 8
        assert sorted(r["doc_id"] for r in docs.collect()) == ([5, 7, 9] if name == "odd" else [])


def test_pipeline_stages_against_brute_force(shipped, spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert corpus_pipeline.language_id(spark, docs, folder).count() == len(rows)
    found = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_runs(spark, docs, folder).collect()}
    want = removed_lines(rows, line_dedup.MIN_WORDS)
    for d, t in rows:
        size, gone = sum(bool(x.strip(" ")) for x in t.split("\n")), want[d, t]
        assert (d in found) == (gone == 0 or gone < size)
        if d in found:
            assert sum(bool(x.strip(" ")) for x in found[d].split("\n")) == size - gone
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in corpus_pipeline.without_benchmark(spark, docs, folder).collect()}
    assert clean == {d for d, t in rows if not contamination(t, items)[1]}
    stay = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()}
    assert stay == {c for _, _, c in components_of(rows)}


def test_sets_that_share_a_passage_do_not_meet_each_other(shipped, monkeypatch):
    """A passage of 100 words and some 15 to 19 own words: nothing links, and the pairs that meet grow with the documents."""
    met, real = [], jaccard_join.possible
    def counted(percent):
        met.append(percent)
        return real(percent)
    monkeypatch.setattr(jaccard_join, "possible", counted)
    passage = " ".join(f"shared{k}" for k in range(100))
    pairs = []
    for n in (100, 200, 400):
        pick = random.Random(n)
        rows = [(d, passage + " " + " ".join(f"own{d}x{k}" for k in range(pick.randint(15, 19)))) for d in range(n)]
        docs = shipped.createDataFrame(rows, "doc_id long, text string")
        sketches = jaccard_join.sketches(docs, 80, ["doc_id"], "text")
        sets = jaccard_join.token_sets(docs, jaccard_join.suspects(sketches, 80), "text", "doc_id")
        buckets = jaccard_join.rare_prefixes(sets, 80).withColumns({"root": F.col("node"), "in_main": F.lit(False)})
        few = jaccard_join.partners(buckets, 80).groupBy("token", "band").agg(F.count("*").alias("all"), F.count_if("equal").alias("roomy"))
        pairs.append(few.agg(F.sum(F.col("roomy") * F.col("all"))).first()[0] or 0)
        assert jaccard_join.classes(docs).filter("component_id <> doc_id").count() == 0
    assert met and pairs[2] <= 5 * max(pairs[0], 400)


def test_tight_and_roomy_sets_still_link(shipped):
    """Sets of many sizes around a shared passage against all pairs: no link is lost by bands or by room."""
    pick, rows = random.Random(9), []
    passage = [f"shared{k}" for k in range(60)]
    for d in range(90):
        cut = passage[: pick.choice([60, 60, 55, 50])]
        rows.append((d, " ".join(cut + [f"own{d if pick.random() < 0.7 else d % 9}x{k}" for k in range(pick.choice([0, 1, 3, 6, 9, 12, 15, 25]))])))
    found = jaccard_join.classes(shipped.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == components_of(rows)
