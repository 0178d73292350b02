"""Operators that take each text on its own: token counts, personal data, language, quality, segmentations."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbline.llm import language, pieces, pii, quality, segmentation, token_counts
from ebbline.llm.common import held_out
from ebbline.llm.queries import tokenizer_file
from tests.llm.conftest import ODD

BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(BPE))


def test_token_counts_of_odd_rows(odd, nothing, library):
    clash = odd.withColumn("n_tokens", F.lit("x"))
    rows = token_counts.count_tokens(clash, tokenizer_file(BPE), keep=["doc_id", "n_tokens", "text"], limit=100).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        want = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (want, len((r["text"] or "").encode()), want > 100)
    assert token_counts.count_tokens(nothing, tokenizer_file(BPE)).count() == 0


def test_token_counts_at_any_boundary(library):
    pick, parts = random.Random(1), [" ", "  ", "\n", "\t", " \n", "a", "the", "Zü", "1", "23", "'s", ".", "<|endoftext|>", "\x1c", "\x85", "漢"]
    counter = pieces.PieceIds(tokenizer_file(BPE), generation=5000)
    for _ in range(1500):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 25)))
        assert len(counter([text])[0]) // counter.kind.itemsize == len(library.encode(text, add_special_tokens=False).ids), repr(text)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((kind, *m.span()))
    return found


def test_base_spans_are_those_of_the_patterns(spark, sf):
    pick = random.Random(2)
    parts = ["@", "a", ".", "1", "2", "+", "-", " ", "25", "(", "com", "4111 1111 1111 1111", "é", "_", "192.168.0.1", "http://", "+1 (743) 555-3824"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 30))) for _ in range(5000)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for text in texts:
        assert [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == base_spans(text), repr(text)


def test_added_spans_and_masks():
    text = "see https://a.example/x?y=1. Account no: 1234 5678 9012, token=abcdef99887766; nothing."
    assert [(k, text[a:b]) for k, a, b in pii.find_spans(text) if k in ("url", "account")] == [
        ("url", "https://a.example/x?y=1"), ("account", "1234 5678 9012"), ("account", "abcdef99887766")]
    assert pii.redact("mail a@b.example now", pii.find_spans("mail a@b.example now")) == "mail <email> now"
    assert pii.redact(None, []) is None


def test_personal_data_of_odd_rows(odd, nothing):
    clash = odd.withColumn("spans", F.lit(1)).unionByName(odd.limit(1).withColumns({"text": F.lit("x@y.example +49 (30) 1234-567"), "spans": F.lit(2)}))
    rows = pii.find_pii(clash, keep=["doc_id", "spans"], masked=True).collect()
    assert len(rows) == len(ODD) + 1
    assert sum(r["n_email"] for r in rows) == 1 and sum(r["n_phone"] for r in rows) == 1
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty and r["spans"] == "" for r in rows if not r["n_email"])
    assert pii.find_pii(nothing).count() == 0


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "+1 " + "(" * 300_000):
        pii.find_spans(text)


def test_language_on_held_out_texts(shipped, sf):
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language.fit(docs, "text", "lang", learn=~held_out(), key="doc_id")
    found = language.identify(docs, net, keep=["doc_id", "lang"]).withColumn("held_out", held_out()).filter("held_out").collect()
    assert len(found) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_of_odd_rows(odd, nothing):
    net = language.fit(odd.filter("lang IS NOT NULL"), "text", "lang", learn=F.lit(True), key="doc_id")
    rows = language.identify(odd.withColumn("score", F.lit("x")), net, keep=["doc_id", "score", "text"]).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        letters = r["text"] and re.search(r"[^\W\d_]", r["text"])
        assert (r["lang_pred"] in ("en", "fr")) == bool(letters) and (letters or r["score"] == 0)
    assert language.fit(nothing, "text", "lang", learn=F.lit(True), key="doc_id") is None
    assert {r["lang_pred"] for r in language.identify(odd, None).collect()} == {"und"}
    assert language.identify(nothing, net).count() == 0


def test_windows_cover_each_text():
    texts = [b"", b"a", b"abc" * 200, bytes(range(250)) + b"x" * 6, b"y" * 257]
    buffer, starts, owner, held = language.windows_of(texts)
    for k, text in enumerate(texts):
        seen = set()
        for s in starts[owner == k]:
            window = buffer[s : s + language.WINDOW]
            for i in range(len(window) - 3):
                seen.add(tuple(window[i : i + 4]))
        for i in range(len(text) - 3):
            assert tuple(text[i : i + 4]) in seen
    assert (held[owner == 2] > 0).all()


def test_tables_give_what_the_filters_give():
    net = language.ByteCNN.start(["a", "b", "c"], seed=3)
    text = "Où est-il, the 漢字?".encode() * 30
    logits = language.Scorer(net).logits([text])[0]
    buffer, starts, _, held = language.windows_of([text])
    want = np.zeros(3)
    for s, weight in zip(starts, held):
        e = net.embedding[buffer[s : s + language.WINDOW]]
        wide = np.concatenate([e[k : len(e) - 3 + k] for k in range(4)], axis=1)
        want += weight * (np.maximum((wide @ net.filters).max(axis=0) + net.bias, 0) @ net.out + net.out_bias)
    assert np.allclose(logits, want / held.sum(), atol=1e-3)


def test_pairwise_part_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    w, v = rng.normal(size=50), rng.normal(size=(50, 4))
    rows = [(np.array([1, 7, 30]), np.array([0.5, 2.0, -1.0])), (np.array([4]), np.array([3.0]))]
    got = quality.raw(*quality.flat(rows), 0.25, w, v)[0]
    for (index, value), found in zip(rows, got):
        want = 0.25 + w[index] @ value
        want += sum(v[a] @ v[b] * x * y for i, (a, x) in enumerate(zip(index, value)) for b, y in list(zip(index, value))[i + 1 :])
        assert math.isclose(found, want)


def test_quality_on_held_out_rows(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = shipped.read.parquet("/root/testdata/sf0.01/labels.parquet")
    machine = quality.fit(docs, labels, learn=~held_out())
    rows = quality.score(docs, machine).join(labels, "doc_id").filter(held_out()).collect()
    good, bad = [[r["score"] for r in rows if r["quality"] == q] for q in (1, 0)]
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert sum(g >= 0.3 for g in good) >= 0.97 * len(good)


def test_quality_of_odd_rows(shipped, odd, nothing):
    labels = shipped.createDataFrame([(1, 1), (5, 0), (5, None), (None, 1), (9, 0)], "doc_id long, quality int")
    docs = odd.withColumns({"n_chars": F.lit(None).cast("long"), "score": F.lit("x")})
    machine = quality.fit(docs, labels, learn=F.lit(True))
    rows = quality.score(docs, machine, keep=["doc_id", "score", "text"]).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert quality.fit(docs, labels.limit(0), learn=F.lit(True)) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(nothing.withColumn("n_chars", F.lit(1)), machine).count() == 0


def all_segmentations(vocabulary, text):
    """Ids and log-probability of every segmentation, by brute force over a small text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECES))
    word = segmentation.SPACE + text.replace(" ", segmentation.SPACE)
    found = []

    def grow(at, ids):
        if at == len(word):
            found.append(tuple(ids))
        for end in range(at + 1, len(word) + 1):
            k = model.piece_to_id(word[at:end])
            if k > 2 and not model.is_byte(k):
                grow(end, [*ids, k])
        if at < len(word) and model.piece_to_id(word[at]) == 0:
            grow(at + 1, [*ids, *(vocabulary.bytes[b] for b in word[at].encode())])

    grow(0, [])
    weight = {ids: math.exp(sum(vocabulary.weight[k] for k in ids)) for ids in found}
    total = sum(weight.values())
    return {ids: w / total for ids, w in weight.items()}


@pytest.mark.parametrize("alpha", [1.0, 0.2])
def test_samples_follow_the_distribution_without_replacement(alpha):
    lattices = segmentation.Lattices(segmentation.Vocabulary(tokenizer_file(PIECES), alpha))
    p, n = all_segmentations(lattices.vocabulary, "the 漢\x07"), 20_000
    keys = segmentation.spread(np.arange(n, dtype=np.uint64))
    rows = segmentation.encode_group(lattices, ["the 漢\x07"] * n, keys, 3, True).to_pylist()
    first, pairs, weight = collections.Counter(), collections.Counter(), 0.0
    for r in rows:
        ids = [tuple(s["ids"]) for s in r]
        assert len(set(ids)) == len(ids) == min(3, len(p)) and all(s["exact"] for s in r)
        assert [s["rank"] for s in r] == [1, 2, 3] and r[0]["perturbed"] >= r[1]["perturbed"] >= r[2]["perturbed"]
        assert all(abs(math.log(p[i]) - s["log_prob"]) < 1e-4 for i, s in zip(ids, r))
        first[ids[0]] += 1
        pairs[ids[0], ids[1]] += 1
        weight += sum(p[i] / s["inclusion"] for i, s in zip(ids, r))
    likely = sorted(p, key=p.get)[-4:]
    for a in likely:
        assert abs(first[a] / n - p[a]) < 5 * math.sqrt(p[a] / n) + 1e-3
        for b in likely:
            if a != b:
                want = p[a] * p[b] / (1 - p[a])
                assert abs(pairs[a, b] / n - want) < 5 * math.sqrt(want / n) + 1e-3
    assert abs(weight / n - 1) < 0.05  # inclusion scores make the sample's weights sum to one


def test_segmentations_of_odd_rows(odd, nothing):
    path = tokenizer_file(PIECES)
    rows = segmentation.sample_segmentations(odd.withColumn("samples", F.lit(1)), path, keep=["doc_id", "samples", "text"]).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r["text"] is None:
            assert r["samples"] is None
        elif not r["text"]:
            assert [(s["ids"], s["log_prob"], s["inclusion"]) for s in r["samples"]] == [([], 0.0, 1.0)]
        else:
            assert len(r["samples"]) == 2 and all(s["exact"] for s in r["samples"])
    same = [r["samples"] for r in rows if r["doc_id"] == 6]
    assert same[0] == same[1]
    assert segmentation.sample_segmentations(nothing, path).count() == 0
    ids = segmentation.sample_segmentations(odd, path, k=1, keep=["doc_id", "text"]).select("doc_id", "text", F.col("samples")[0]["ids"].alias("ids"))
    for r in segmentation.decode_ids(ids, path, keep=["text"]).collect():
        assert r["decoded"] == (r["text"] and r["text"].replace("▁", " ")) or (r["text"] is None and r["decoded"] is None)


def test_groups_do_not_change_samples(odd):
    path = tokenizer_file(PIECES)
    few = segmentation.sample_segmentations(odd, path, group_bytes=1).collect()
    many = segmentation.sample_segmentations(odd.coalesce(1), path).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    for a, b in zip(sorted(few, key=key), sorted(many, key=key)):
        assert [s["ids"] for s in a["samples"] or ()] == [s["ids"] for s in b["samples"] or ()]


def test_segmentations_do_not_depend_on_what_is_remembered():
    path = tokenizer_file(PIECES)
    vocabulary, texts = segmentation.Vocabulary(path, 1.0), ["the cat sat", "a cat and a dog 漢字 ran", "x" * 700 + " end", "", None, "the dog", "q1w2 " * 30]
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list("abcde fgh"), 60)) for _ in range(40)]
    keys = segmentation.spread(np.arange(len(texts), dtype=np.uint64))
    whole = segmentation.encode_group(segmentation.Lattices(vocabulary), texts, keys, 3, True).to_pylist()
    few = segmentation.Lattices(vocabulary, limit=20_000)
    for _ in range(2):
        alone = [segmentation.encode_group(few, texts[k : k + 2], keys[k : k + 2], 3, True).to_pylist() for k in range(0, len(texts), 2)]
        assert [x for part in alone for x in part] == whole
    assert len(few.known) < len({w for t in texts if t for w in segmentation.split_words(t)})


def test_distinct_words_of_a_group_are_split_words():
    texts = [
        "the cat sat", "", " ", "  two  spaces ", "a\n\nb \n c", "\n", " lead", "trail ", "▁ under▁ ▁▁line▁", "cat the\tcat\u00a0x\r\n y", "漢字 😀", "the cat sat\n", "\x00 \x00",
    ]
    words, place, sizes = segmentation.split_group(texts)
    ends = np.cumsum(sizes)
    for text, size, end in zip(texts, sizes.tolist(), ends.tolist(), strict=True):
        assert [words[k] for k in place[end - size : end]] == (segmentation.split_words(text) if text else []), repr(text)
    assert len(words) == len(set(words)) and ends[-1] == len(place)
    assert segmentation.split_group([])[0] == [] and len(segmentation.split_group([""])[1]) == 0


def test_lattices_grow_in_room_of_their_own():
    vocabulary = segmentation.Vocabulary(tokenizer_file(PIECES), 1.0)
    once, often = segmentation.Lattices(vocabulary), segmentation.Lattices(vocabulary)
    words = [f"▁w{k}é{k % 7}漢" for k in range(400)]
    once.numbers(words)
    moved = 0
    for k in range(0, len(words), 4):
        held = often.log
        often.numbers(words[k : k + 4])
        moved += often.log is not held
    assert moved < 40  # of 100 groups with new words
    assert (once.nodes, once.edges, once.known) == (often.nodes, often.edges, often.known)
    for name, size in (("first", once.nodes + 1), ("entry", len(words) + 1), ("piece", once.edges), ("step", once.edges), ("source", once.edges), ("upto", once.edges), ("log", once.edges)):
        assert (getattr(once, name)[:size] == getattr(often, name)[:size]).all(), name


def test_segmentation_of_a_long_word():
    path = tokenizer_file(PIECES)
    lattices = segmentation.Lattices(segmentation.Vocabulary(path, 1.0))
    text = "".join(np.random.default_rng(1).choice(list("abcdefghé漢"), 70_000))
    (samples,) = segmentation.encode_group(lattices, [text], np.array([7], np.uint64), 2, True).to_pylist()
    assert len(samples) == 2 and all(s["exact"] for s in samples) and samples[0]["ids"] != samples[1]["ids"]


def test_cues_in_any_case_and_check_digits():
    account = lambda t: [t[a:b] for kind, a, b in pii.find_spans(t) if kind == "account"]
    assert account("API key: abcd12345678, User ID: 12345678") == ["abcd12345678", "12345678"]
    assert account("iBaN: GB82 WEST 1234 5698 7654 32 is mine") == ["GB82 WEST 1234 5698 7654 32"]
    assert account("IBAN: GB82 WEST 1234 5698 7654 33") == [] and pii.iban("GB82WEST12345698765432")
    assert account("SSN 123-45-6789") == ["123-45-6789"] and account("ssn: 000-45-6789") == [] and account("ssn 123-00-6789") == []
    assert account("Password: hunter2secret and so on") == ["hunter2secret"] and account("the password was changed again") == []
    assert account("İİ Account no. 12345678") == ["12345678"]


def test_stores_have_names_that_pyarrow_knows():
    from ebbline.llm import warc

    assert type(warc.open_folder("s3a://bucket/folder?region=us-east-1")[0]).__name__ == "S3FileSystem"
    assert warc.open_folder("file:///tmp/x")[1] == "/tmp/x" and warc.open_folder("/tmp/x")[1] == "/tmp/x"
