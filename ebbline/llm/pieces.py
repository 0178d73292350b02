"""Token ids of whole texts by a byte-level BPE file, through pieces that are encoded once.

Texts are split where the tokenizer's own pattern always starts a new token: before a space behind a
non-space.  What a task has seen lately is remembered as bytes of ids, in two generations bounded by
bytes, so memory does not depend on the texts.  New pieces without white space inside go to the library
joined by spaces; the tokens that begin with a space tell where each one starts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space between two white-space characters is inside a run that the tokenizer keeps together.
UNSAFE = re.compile(r"\s (?:\s|\Z)")
SAFE_SPLIT = re.compile(r"(?<=\S)(?= )")
#: Pieces that are encoded by themselves: with white space (by any version's list), special strings or nothing.
ALONE = re.compile(r"[\s\u180e\u200b-\u200d\u2060\ufeff]|<\||\|>|\A\Z")
#: Longer pieces are cut further and never remembered.
LONG = 64
#: Where letters and digits meet a new token starts, if no apostrophe is near.
INSIDE = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
#: Lines in one piece: between two of them a line end stands alone, which is a token of its own.
LINES = re.compile("[^\\s\u180e\u200b-\u200d\u2060\ufeff<>|]+(?:\\n[^\\s\u180e\u200b-\u200d\u2060\ufeff<>|]+)+")
#: A word and the marks behind it: with its space the word is one piece of the pattern, and so are the marks.
WORD = "\\A(?P<base>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<tail>[.,;:!?\\-\")]*)\\z"
#: Bytes a generation remembers, keys and ids with their overhead; there are two.
GENERATION, PIECE_BYTES = 96 << 20, 180


def split_safely(text: str) -> tuple[str, list[str]]:
    """The first piece, and the other pieces without the space they all start with."""
    if UNSAFE.search(text):
        first, *rest = SAFE_SPLIT.split(text)
        return first, [piece[1:] for piece in rest]
    first, *rest = text.split(" ")
    return first, rest


def strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


class PieceIds:
    """Ids of texts as bytes, equal to the ``tokenizers`` library's for the whole text.

    ``kind``: little-endian, two bytes an id where the vocabulary allows it, else four.
    """

    def __init__(self, path: str, generation: int = GENERATION):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.generation = Tokenizer.from_file(path), generation
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model = self.tokenizer.model
        # the pre-tokenizer writes a Latin-1 letter's two bytes as two characters; plain ASCII stays as it is
        self.characters = {b: chr(b) for b in range(0x21, 0x7F)} | {b: chr(b) for b in [*range(0xA1, 0xAD), *range(0xAE, 0x100)]}
        self.characters |= {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in self.characters)}
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        starts = [(self.tokenizer.id_to_token(k) or "").startswith("Ġ") for k in range(size)]
        self.starts = np.array(starts)
        (self.line_end,) = self._encode(["\n"])
        self.starts_of: dict[str, bytes] = {}  # what stands at the start of a line
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _encode(self, texts: list[str]) -> Iterable[bytes]:
        for at in range(0, len(texts), 1024):
            for x in self.tokenizer.encode_batch_fast(texts[at : at + 1024], add_special_tokens=False):
                yield np.array(x.ids, self.kind).tobytes()

    def _cut(self, piece: str) -> bytes:
        """A long piece in parts, with its space in front."""
        if "'" in piece or "<|" in piece:
            return b"".join(self._encode([piece]))
        return b"".join(self._encode(INSIDE.split(piece)))

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words with a space in front, each one a piece of the pattern by itself."""
        found = list(map(self.young.get, words))
        new = []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            word = words[k]
            ids = self.old.get(word)
            if ids is None:
                new.append(k)
            else:
                found[k] = self.young[word] = ids
                self.held += PIECE_BYTES + len(word) + len(ids)
        for at in range(0, len(new), 4096):
            some = [words[k] for k in new[at : at + 4096]]
            lists = [[t.id for t in self.model.tokenize("Ġ" + (p if p.isascii() else self._spelled(p)))] for p in some]
            self._remember(some, np.array(list(chain.from_iterable(lists)), self.kind), np.cumsum([0, *map(len, lists[:-1])]))
        for k in new:
            found[k] = self.young[words[k]]
        return found

    def _others(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces that are no word with marks, with a space in front."""
        found, new = list(map(self.young.get, pieces)), []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            piece = pieces[k]
            ids = self.old.get(piece)
            if ids is not None:
                found[k] = self.young[piece] = ids
                self.held += PIECE_BYTES + len(piece) + len(ids)
            elif len(piece) > LONG:
                found[k] = self._cut(" " + piece)
            else:
                new.append(k)
        self._learn([pieces[k] for k in new])
        for k in new:
            found[k] = self.young[pieces[k]]
        return found

    def _learn(self, new: list[str]) -> None:
        """Ids of new pieces into the young generation."""
        plain, odd, lines = [], [], []
        for p in new:
            if LINES.fullmatch(p):
                lines.append(p)
            elif ALONE.search(p):
                odd.append(p)
            else:
                plain.append(p)
        self.young.update(zip(odd, self._encode([" " + p for p in odd])))
        self.held += sum(len(self.young[p]) + PIECE_BYTES + len(p) for p in odd)
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            (encoded,) = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            ids = np.array(encoded.ids, self.kind)
            starts = np.flatnonzero(self.starts[ids])
            if len(starts) != len(some):
                raise ValueError("the tokenizer does not start a token at each space")
            self._remember(some, ids, starts)
        if not lines:
            return
        split = [p.split("\n") for p in lines]
        starting = list({line for _, *others in split for line in others}.difference(self.starts_of))
        self.starts_of.update(zip(starting, self._bare(starting)))
        self.held += PIECE_BYTES * len(starting)
        firsts = list({first for first, *_ in split})
        ids_of = dict(zip(firsts, self._distinct(pa.array(firsts, pa.string())).to_pylist()))
        for p, (first, *others) in zip(lines, split):
            self.young[p] = ids = b"".join([ids_of[first], *[self.line_end + self.starts_of[line] for line in others]])
            self.held += PIECE_BYTES + len(p) + len(ids)

    def _distinct(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces with a space in front: words and the marks behind them each once, the others whole."""
        short = pc.if_else(pc.less_equal(pc.utf8_length(pieces), LONG), pieces, pa.scalar(None, pa.string()))
        parts = pc.extract_regex(short, WORD)
        word = parts.is_valid()
        parts = parts.filter(word)
        base, tail = (pc.struct_field(parts, name).dictionary_encode() for name in ("base", "tail"))
        bases = pa.array(self._words(strings(base.dictionary)), pa.binary())
        tails = pa.array(list(self._encode(strings(tail.dictionary))), pa.binary())
        words = pc.binary_join_element_wise(bases.take(base.indices), tails.take(tail.indices), b"")
        if len(words) == len(pieces):
            return words
        others = pa.array(self._others(strings(pieces.filter(pc.invert(word)))), pa.binary())
        word = word.to_numpy(zero_copy_only=False)
        place = np.where(word, np.cumsum(word) - 1, len(words) + np.cumsum(~word) - 1)
        return pa.concat_arrays([words, others]).take(pa.array(place))

    def _bare(self, lines: list[str]) -> list[bytes]:
        """Ids of texts without a space in front."""
        words = {line: np.array([t.id for t in self.model.tokenize(line)], self.kind).tobytes() for line in lines if line.isalpha() and line.isascii()}
        others = [line for line in lines if line not in words]
        words.update(zip(others, self._encode(others)))
        return [words[line] for line in lines]

    def _spelled(self, word: str) -> str:
        """The word in the characters that stand for its bytes."""
        return "".join([self.characters[b] for b in word.encode()])

    def _remember(self, some: list[str], ids: np.ndarray, starts: np.ndarray) -> None:
        data, cuts = ids.tobytes(), (starts * self.kind.itemsize).tolist()
        self.young.update(zip(some, map(data.__getitem__, map(slice, cuts, [*cuts[1:], len(data)]))))
        self.held += len(data) + PIECE_BYTES * len(some) + sum(map(len, some))

    def arrays(self, texts: pa.Array) -> pa.Array:
        """Ids of each text as binary; null is empty.  Arrow splits, finds the distinct pieces and joins."""
        if self.held > self.generation:
            self.old, self.young, self.held, self.starts_of = self.young, {}, 0, {}
        texts = texts.fill_null("")
        split = pc.split_pattern(texts, " ")
        unsafe = np.array([UNSAFE.search(t) is not None for t in strings(texts)], bool)
        if unsafe.any():
            apart = [[first, *rest] for first, rest in map(split_safely, strings(texts.filter(pa.array(unsafe))))]
            place = np.where(unsafe, (~unsafe).sum() + np.cumsum(unsafe) - 1, np.cumsum(~unsafe) - 1)
            split = pa.concat_arrays([split.filter(pa.array(~unsafe)), pa.array(apart, split.type)]).take(pa.array(place))
        flat, counts = split.flatten(), np.asarray(split.value_lengths()).astype(np.int64)
        starts = np.cumsum(counts) - counts
        firsts = strings(flat.take(pa.array(starts)))
        heads = [self._cut(f) if len(f) > LONG else head for head, f in zip(self._encode([f if len(f) <= LONG else "" for f in firsts]), firsts)]
        behind = np.ones(len(flat), bool)
        behind[starts] = False
        pieces = flat.filter(pa.array(behind)).dictionary_encode()
        ids = self._distinct(pieces.dictionary).take(pieces.indices)
        ends = np.concatenate([[0], np.cumsum(counts - 1)]).astype(np.int32)
        rest = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), ids), b"")
        return pc.binary_join_element_wise(pa.array(heads, pa.binary()), rest, b"")

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return self.arrays(pa.array(texts, pa.string())).to_pylist()


@lru_cache(maxsize=1)
def piece_ids(path: str) -> PieceIds:
    """Stays in the worker for its next tasks; its memory has a bound."""
    return PieceIds(path)
