"""Importance resampling, token files and spelling variants against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ebbline.llm import huffman, importance, pieces, spelling, token_file
from ebbline.llm.queries import tokenizer_file

BYTE_BPE = "byte_bpe_50k.json"


# -- importance ----------------------------------------------------------------------------

def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features_of(text, buckets):
    w = words_of(text)
    return [zlib.crc32(x.encode()) % buckets for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def importance_by_hand(docs, target, buckets, share=25, seed=7):
    s = Counter(b for _, t in docs for b in features_of(t, buckets))
    t = Counter(b for x in target for b in features_of(x, buckets))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for key, text in docs:
        f = features_of(text, buckets)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in f) // max(1, len(f))
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    order = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(order[: share * len(order) // 100]):
        r[5] = k + 1
    return out


def test_importance_equals_brute_force(shipped, odd):
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}" for a in "abc déf GHI".split() for b in range(40)]
    docs = [(k % 150, " ".join(rng.choice(vocabulary, int(rng.integers(1, 60)))) + rng.choice(["", "-", " !"])) for k in range(180)]
    docs += [(r["doc_id"], r["text"]) for r in odd.collect()]
    target = [t for _, t in docs[:12]] + [None, ""]
    found = importance.resample(
        shipped.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "tie": F.lit(1), "part": F.lit(2)}),
        shipped.createDataFrame([(t,) for t in target], "text string"), buckets=97,
    )
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = importance_by_hand(docs, target, 97)
    drop = lambda rows: sorted(map(str, (tuple(r)[:5] for r in rows)))
    got = [tuple(r) for r in found.collect()]
    assert drop(got) == drop(want)
    ranked = lambda rows: sorted((r[5], r[4], r[0]) for r in rows if r[5] is not None)
    assert ranked(got) == ranked(want) and len(ranked(got)) > 20


def test_importance_of_nothing_and_towards_nothing(shipped, odd, nothing):
    assert importance.resample(nothing, odd).collect() == []
    rows = importance.resample(odd, nothing).collect()
    assert len(rows) == odd.count() and all(r["weight"] == 0 for r in rows if r["n_features"] == 0)


def test_features_of_groups_do_not_depend_on_the_cut(shipped, odd):
    a = importance.bucket_counts(odd)
    b = importance.bucket_counts(odd.repartition(5), group_bytes=1)
    assert (a == b).all() and a.sum() == sum(len(features_of(r["text"], 10)) for r in odd.collect())


# -- token files ---------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(6))
def test_code_lengths_are_optimal_and_limited(seed):
    rng = np.random.default_rng(seed)
    counts = rng.geometric(0.2, 40) ** rng.integers(1, 9)
    counts[rng.integers(0, 40, 5)] = 0
    free, tight = huffman.code_lengths(counts, 30), huffman.code_lengths(counts, 6)
    import heapq

    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        cost += pair
        heapq.heappush(heap, pair)
    assert int((counts * free).sum()) == cost
    for lengths, limit in ((free, 30), (tight, 6)):
        used = lengths[counts > 0].astype(float)
        assert (lengths[counts == 0] == 0).all() and used.max() <= limit and (2.0**-used).sum() == 1
    assert int((counts * tight).sum()) >= cost


def test_codes_round_trip_in_blocks():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 20_000), 3000).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids), 12)
    data, starts = huffman.pack(ids, huffman.canonical_codes(lengths), lengths, 333)
    counts = np.full(len(starts), 333)
    counts[-1] = len(ids) - 333 * (len(starts) - 1)
    table = huffman.Table(lengths)
    assert (table.unpack(data, starts, counts) == ids).all()
    some = slice(7, 11)
    assert (table.unpack(data, starts[some], counts[some]) == ids[333 * 7 : 333 * 11]).all()
    assert len(data) < 2 * len(ids)
    alone = huffman.code_lengths(np.array([0, 0, 9]))
    assert alone.tolist() == [0, 0, 1]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)


STRANGE = [
    "  two  spaces ", "a\n\nb \n c", "tab\t x  \t y", "it's we'll DON'T 'tis", "<|endoftext|>", "x<|endoftext|> y <|endoftext|>z", "é漢字 😀😀    x y ​ z",
    "Fin, fin. naïve! «Ørsted» Łódź, ǅ ǆ; (end) said: \"no.\" a-b-c well-known, -- x... don't. x'", "µm ªº ÷× ñ\u0303o e\u0301t, ɐ",
    "a1b22c333 " * 50, "abc123" * 2000, "q" * 3000, "'s" * 200, "no_space_but-signs!" * 300, " lead", "trail ", " ", "\n", "᠎ a᠎ b", "x   y", "ends \u0085 z",
]


def test_pieces_equal_the_library():
    work = pieces.PieceIds(tokenizer_file(BYTE_BPE), generation=5000)
    texts = [*STRANGE, None, "", *(" ".join(STRANGE[k:]) for k in range(len(STRANGE)))]
    for _ in range(3):  # the generations change between the rounds
        for t, got in zip(texts, work(texts)):
            want = work.tokenizer.encode(t or "", add_special_tokens=False).ids
            assert np.frombuffer(got, work.kind).tolist() == want, t
    assert work.old and not any(len(p) > pieces.LONG for p in [*work.young, *work.old])


def test_arrays_of_texts_with_each_word_learned_once(monkeypatch):
    work = pieces.PieceIds(tokenizer_file(BYTE_BPE))
    learned = []
    monkeypatch.setattr(work, "_remember", lambda some, *rest: (learned.extend(some), pieces.PieceIds._remember(work, some, *rest)))
    texts = pa.array(["cut off", "one two, two. two! one", None, "  two  ", "", *STRANGE, "one\ntwo two) Two", "cut off"]).slice(1, len(STRANGE) + 5)
    for _ in range(2):
        for t, got in zip(texts.to_pylist(), work.arrays(texts).to_pylist(), strict=True):
            assert np.frombuffer(got, work.kind).tolist() == work.tokenizer.encode(t or "", add_special_tokens=False).ids, t
    assert len(learned) == len(set(learned)) and {"two", "Two"} <= set(learned)
    assert not {"two,", "two.", "two!", "two)"} & set(work.young)  # a word with marks takes no memory of its own
    assert work.arrays(pa.array([], pa.string())).to_pylist() == []


def test_token_files_round_trip(shipped, odd, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file(BYTE_BPE))
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(100 + k, t) for k, t in enumerate(STRANGE)] + [(3, "again"), (-5, "first")]
    df = shipped.createDataFrame(docs, "doc_id long, text string").withColumns({"ids": F.lit(1), "n": F.lit(2), "width": F.lit(0), "start": F.lit(3), "part": F.lit(4)})
    folder = str(tmp_path / "tokens")
    found = [r.asDict() for r in token_file.token_files(df, tokenizer_file(BYTE_BPE), folder, file_ids=2000).collect()]
    ids_of = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted([(r["doc_id"], r["ids"]) for r in found], key=key) == sorted([(k, ids_of(t)) for k, t in docs], key=key)
    found.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((k for k, _ in docs), key=lambda k: (k is not None, k or 0))
    at = 0
    for r in found:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += len(r["ids"])
    manifest = shipped.read.parquet(f"{folder}/files").orderBy("part").collect()
    assert len(manifest) > 1 and sum(r["n_ids"] for r in manifest) == at


def test_single_blocks_are_read(tmp_path):
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 500, int(rng.integers(0, 400))).astype("<u4") for _ in range(80)]
    flat = np.concatenate(docs)
    lengths = huffman.code_lengths(np.bincount(flat, minlength=500))
    path = tmp_path / "x.tok"
    with open(path, "wb") as out:
        writer = token_file.Writer(out, lengths, block=64, segment_ids=1000)
        for k, d in enumerate(docs):
            writer.add(k, d.tobytes())
        size = writer.close()
    assert size == path.stat().st_size
    with open(path, "rb") as file:
        reader = token_file.Reader(file, size)
        assert (np.concatenate([reader.segment(k) for k in range(len(reader.segments))]) == flat).all()
        for a, b in ((0, 1), (63, 65), (999, 1300), (0, len(flat)), (len(flat) - 1, len(flat)), (5, 5)):
            assert (reader.ids(a, b) == flat[a:b]).all()
    damaged = bytearray(path.read_bytes())
    damaged[-30] ^= 1
    path.write_bytes(damaged)
    with open(path, "rb") as file, pytest.raises(ValueError):
        token_file.Reader(file, size)


def test_token_files_of_nothing(nothing):
    assert token_file.token_files(nothing, tokenizer_file(BYTE_BPE)).collect() == []


# -- spelling ------------------------------------------------------------------------------

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def spelling_by_hand(docs, slip=199, least=5):
    counts = Counter()
    for key, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                counts[w] += 1
    n = {w: c for w, c in counts.items() if c >= least}
    out, forms = [], {}
    for w in n:
        close = sorted((-n[x], x) for x in n if near(w, x))
        if close and -close[0][0] >= 5 * n[w]:
            forms[w] = close[0][1]
        out.append([w, n[w], len(close), forms.get(w), n[forms[w]] if w in forms else None])
    for r in out:
        root = r[0]
        while root in forms:
            root = forms[root]
        r.append(root)
    return sorted(map(tuple, out))


def variants(rng, word, letters):
    at, kind = int(rng.integers(0, len(word))), int(rng.integers(0, 3))
    c = letters[int(rng.integers(0, len(letters)))]
    return [word[:at] + word[at + 1 :], word[:at] + c + word[at:], word[:at] + c + word[at + 1 :]][kind]


@pytest.mark.parametrize("letters,crowded", [("abcdefghij", 64), ("ab", 64), ("aé", 2), ("abcÀÿ", 1)])
def test_spelling_equals_brute_force(shipped, monkeypatch, letters, crowded):
    monkeypatch.setattr(spelling, "CROWDED", crowded)
    rng = np.random.default_rng(len(letters))
    words = ["".join(rng.choice(list(letters), int(rng.integers(6, 12)))) for _ in range(25)]
    words += [variants(rng, w, letters) for w in words for _ in range(4)]
    words += [variants(rng, w, letters) for w in words[25:60]]
    docs = [(k, " ".join(np.repeat(w, int(5 ** rng.uniform(0.9, 3))))) for k, w in enumerate(words)]
    docs += [(None, "Common words, Common Words"), (7, None), (8, ""), (9, "x" * 5000), (10, "naïveté " * 6), (10, "naïveté " * 6)]
    df = shipped.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(2), "key": F.lit(3), "k": F.lit(4)})
    got = sorted(tuple(r) for r in spelling.group_variants(df, slip=19).select("word", "n", "n_near", "form", "form_n", "root").collect())
    want = spelling_by_hand(docs, slip=19)
    assert got == want and any(r[3] for r in want)


def test_pivots_are_disjoint_and_least():
    rng = np.random.default_rng(2)
    for _ in range(300):
        places = np.sort(rng.choice(12, int(rng.integers(3, 8)), replace=False))
        grams = [(int(p), int(rng.integers(0, 9))) for p in places]
        a, b = spelling.pivots(grams)
        rank = dict(grams)
        best = min(rank[p] + rank[q] for p, _ in grams for q, _ in grams if q >= p + 2)
        assert b >= a + 2 and rank[a] + rank[b] == best


def test_spelling_of_nothing_and_odd_rows(odd, nothing):
    assert spelling.group_variants(nothing).collect() == []
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = spelling_by_hand(docs)
    assert sorted(tuple(r) for r in spelling.group_variants(odd).select("word", "n", "n_near", "form", "form_n", "root").collect()) == want
